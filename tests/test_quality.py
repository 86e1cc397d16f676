"""Quarantine, wide tables, orphans, periods and packed fields: nulls, blanks, ties, repeats, long texts, empty tables."""

import random
from datetime import datetime, timedelta

import pytest
from locusframe.operators.eav import WideLog, cell_issues, eav_cells, wide
from locusframe.operators.orphans import key_runs, orphan_references
from locusframe.operators.packed import unpacked
from locusframe.operators.periods import periods_and_gaps
from locusframe.operators.quarantine import classify_lines

GOOD = 'c1\ts\texon\t5\t9\t.\t+\t0\tgene_id "g1"; transcript_id "t1";'


def judged(spark, lines):
    rows = spark.createDataFrame([(i, x, "mine") for i, x in enumerate(lines)], "line_id long, raw_line string, reason string")
    return {r["line_id"]: r for r in classify_lines(rows).collect()}


CASES = [
    (GOOD, None, True),
    (GOOD + "\r", None, True),
    (None, None, False),
    ("", None, False),
    (" \t ", None, False),
    ("  # x\ty", None, False),
    ("\r", None, False),
    (GOOD + "\t", "columns", True),
    (GOOD.replace("\t", "    "), "columns", True),
    ("x" + "\t" * 30_000, "columns", True),
    (GOOD.replace('"g1"', '"g1'), "quoting", True),
    (GOOD.replace('"g1"', '"g""1"'), "quoting", True),
    (GOOD.replace('gene_id "g1"', 'gene_id="g1"'), "quoting", True),
    (GOOD + ' note "ends\\";', "quoting", True),
    (GOOD + ' note "a \\"b\\" c";', None, True),
    (GOOD + ' note "a \\\\";', None, True),
    (GOOD + " note a\\\"b;", "quoting", True),
    (GOOD + " note a\\b;;; ;", None, True),
    (GOOD + ' note "' + '\\"' * 60_000 + '";', None, True),
    (GOOD + " k v;" * 30_000, None, True),
    (GOOD + ' note "x; gene_id "', None, True),
    (GOOD.replace("\t5\t9", "\t9\t5"), "value", True),
    (GOOD.replace("\t5\t9", "\t0\t9"), "value", True),
    (GOOD.replace("\t5\t9", "\t+5\t9"), "value", True),
    (GOOD.replace("\t5\t9", "\t5\t1234567890123456789"), "value", True),
    (GOOD.replace("\t.\t+", "\t1.\t+"), "value", True),
    (GOOD.replace("\t.\t+", "\t-1.5e-3\t+"), None, True),
    (GOOD.replace("\t+\t", "\t*\t"), "value", True),
    (GOOD.replace("\t0\t", "\t3\t"), "value", True),
    (GOOD.replace("c1", "c 1"), "value", True),
    (GOOD.replace("c1", "c\u00a01"), "value", True),
    (GOOD.replace("c1", ""), "value", True),
    (GOOD.replace('"g1"', '"?"'), "value", True),
    (GOOD.replace('"g1"', '"\\."'), "value", True),
    (GOOD.replace('gene_id "g1"', 'Gene_ID " "; gene_id "g1"'), "value", True),
    (GOOD.replace(' transcript_id "t1";', ""), "value", True),
    (GOOD.replace(' transcript_id "t1";', "").replace("exon", "Gene"), None, True),
    (GOOD.replace('gene_id "g1"; transcript_id "t1";', "."), "value", True),
    (GOOD.replace('gene_id "g1"; transcript_id "t1";', ""), "value", True),
]


def test_lines(spark):
    found = judged(spark, [c[0] for c in CASES])
    for i, (line, reason, record) in enumerate(CASES):
        assert (found[i]["reason"], found[i]["is_record"]) == (reason, record), (line or "")[:120]
    row = found[0]
    assert (row["start_pos"], row["end_pos"], row["seqid"], row["corrupt_text"]) == (5, 9, "c1", None)
    assert found[7]["corrupt_text"] == GOOD + "\t"


def test_lines_empty(spark):
    assert judged(spark, []) == {}


TYPES = [("flag", "boolean", False), ("level", "long", False), ("gc", "double", False), ("name", "string", False), ("tag", "string", True)]
ATTR = [
    (1, 1, "level", " 3 "), (1, 2, "LEVEL", "+3"), (1, 3, "gc", "0.50"), (1, 4, "gc", "5e-1"), (1, 5, "name", "a"), (1, 6, "Name ", "A"),
    (1, 7, "tag", "x"), (1, 8, "tag", "y"), (1, 7, "tag", "x"), (1, 9, "other", "z"), (1, 10, None, "z"),
    (2, 1, "level", "n/a"), (2, 2, "level", "."), (2, 3, "flag", "T"), (2, 4, "flag", "1"), (2, 5, "gc", "1e400"), (2, 6, "name", None),
    (3, 1, "flag", "yes"), (3, 2, "flag", "no"), (3, 3, "level", "1234567890123456789"), (3, 4, "gc", "-0"), (3, 5, "gc", "0"), (None, 1, "level", "1"),
]
SCHEMA = "rid long, pos int, attr_key string, attr_value string"


def test_wide_and_issues(spark):
    cells = eav_cells(spark.createDataFrame(ATTR, SCHEMA), TYPES)
    rows = {r["rid"]: r for r in wide(cells, TYPES).collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1]["level"], rows[1]["gc"], rows[1]["name"], rows[1]["tag"], rows[1]["flag"]) == (3, 0.5, "A", ["x", "y"], None)
    assert (rows[2]["flag"], rows[2]["level"], rows[2]["name"], rows[2]["tag"]) == (True, None, None, None)
    issues = {tuple(r) for r in cell_issues(cells, TYPES).collect()}
    assert issues == {(1, "name", "conflict"), (2, "level", "untypable"), (3, "flag", "conflict"), (3, "level", "untypable")}


def test_wide_empty(spark):
    cells = eav_cells(spark.createDataFrame([], SCHEMA), TYPES)
    assert wide(cells, TYPES).count() == 0 and cell_issues(cells, TYPES).count() == 0
    assert wide(eav_cells(spark.createDataFrame(ATTR, SCHEMA), []), []).count() == 0


def test_log_equals_one_pass(spark, tmp_path):
    log = WideLog(spark, f"file://{tmp_path}/log", TYPES)
    for i in range(0, len(ATTR), 6):
        log.upsert(spark.createDataFrame(ATTR[i : i + 6], SCHEMA))
    direct = eav_cells(spark.createDataFrame(ATTR, SCHEMA), TYPES)
    want = sorted(map(str, wide(direct, TYPES).collect()))
    assert sorted(map(str, wide(log.cells(), TYPES).collect())) == want
    again = WideLog(spark, f"file://{tmp_path}/log", TYPES)
    assert again.runs == log.runs and len(again.runs) == 4
    assert sorted(map(str, wide(again.cells(), TYPES).collect())) == want
    (tmp_path / "log" / "run-000099-lost").mkdir()
    again.upsert(spark.createDataFrame(ATTR[3:9], SCHEMA))
    old = [tmp_path / "log" / r for r in again.runs]
    again.compact()
    assert len(again.runs) == 1 and all(spark.read.parquet(f"file://{r}").count() == 0 for r in old)
    last = WideLog(spark, f"file://{tmp_path}/log", TYPES)
    assert sorted(map(str, wide(last.cells(), TYPES).collect())) == want
    assert {tuple(r) for r in cell_issues(last.cells(), TYPES).collect()} == {tuple(r) for r in cell_issues(direct, TYPES).collect()}
    assert WideLog(spark, f"file://{tmp_path}/none", TYPES).cells().count() == 0


def test_hot_entity(spark):
    rows = [(7, i, "level", str(i % 5)) for i in range(3000)] + [(i, 1, "level", "1") for i in range(100, 200)]
    cells = eav_cells(spark.createDataFrame(rows, SCHEMA).repartition(8), TYPES)
    assert {tuple(r) for r in cell_issues(cells, TYPES).collect()} == {(7, "level", "conflict")}
    assert {r["rid"]: r["level"] for r in wide(cells, TYPES).collect()}[7] == 2999 % 5


def _orphans(refs, registry):
    out = set()
    for reg, i, at, row in refs:
        own = [(a, w) for r, k, a, w in registry if r == reg and k == i]
        if any(a is not None and at is not None and a <= at and (w is None or at < w) for a, w in own):
            continue
        late = any(a is not None and at is not None and a > at for a, w in own)
        out.add((row, "missing" if not own else "late" if late else "withdrawn"))
    return out


def test_orphans_brute_force(spark):
    rng, t0 = random.Random(5), datetime(2021, 1, 1)
    keys = [f"g{n:05d}" for n in [*range(1, 40), *range(65530, 65542)]] + ["plain", "x9", "12345678901234567890"]
    registry = []
    for k in keys:
        for _ in range(rng.choice([0, 1, 1, 2])):
            a = t0 + timedelta(days=rng.randint(0, 100))
            registry += [("gene", k, a, rng.choice([None, a + timedelta(days=rng.randint(0, 40))]))] * rng.choice([1, 1, 2])
    registry += [("gene", "g00003", None, None), ("gene", None, t0, None)]
    refs = [("gene", rng.choice(keys + ["g00007"] * 60), t0 + timedelta(days=rng.randint(-5, 140)), i) for i in range(1500)]
    refs += [("gene", "g00001", a, 9000 + j) for j, (r, k, a, w) in enumerate(registry) if k == "g00001"] + [("gene", "g00002", None, 9900)]
    left = spark.createDataFrame(refs, "registry string, id string, at timestamp, row_id long").selectExpr("*", "'x' AS stop", "1 AS kind_")
    right = spark.createDataFrame(registry, "registry string, id string, added_at timestamp, withdrawn_at timestamp")
    got = {(r["row_id"], r["kind"]) for r in orphan_references(left, right, len(refs)).collect()}
    assert got == _orphans(refs, registry)


def test_orphans_empty(spark):
    left = spark.createDataFrame([("gene", "g1", datetime(2021, 1, 1), 1)], "registry string, id string, at timestamp, row_id long")
    right = spark.createDataFrame([], "registry string, id string, added_at timestamp, withdrawn_at timestamp")
    assert [r["kind"] for r in orphan_references(left, right, 1).collect()] == ["missing"]
    assert orphan_references(left.limit(0), right, 0).count() == 0


def test_key_runs(spark):
    rows = spark.createDataFrame([("a", f"g{n:03d}") for n in (1, 2, 3, 3, 7, 8)] + [("a", None), ("a", "z")], "registry string, id string")
    runs = {(r["family"], r["run_start"], r["run_end"]) for r in key_runs(rows, "id", ["registry"]).collect()}
    assert runs == {("g:3", 1, 3), ("g:3", 7, 8), ("text:z", 0, 0)}


def _periods(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    gaps = [("gap", a[1] + 1, b[0] - 1) for a, b in zip(out, out[1:])]
    return {("period", *x) for x in map(tuple, out)} | set(gaps)


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_periods_brute_force(spark, block):
    rng = random.Random(block)
    rows = [("k%d" % rng.choice([0, 0, 0, 1, 2]), s := rng.randint(1, 400), s + rng.choice([0, 1, 3, 9, 60])) for _ in range(160)]
    rows += rows[:5] + [("k0", None, 3), ("k0", 3, None), ("k0", 9, 2), ("k0", 0, 5), (None, 1, 2), ("k3", 5, 9_000_000_000_000_000_000)] + [("k4", 10, 12), ("k4", 13, 14), ("k4", 16, 16)]
    df = spark.createDataFrame(rows, "k string, start_pos long, end_pos long").selectExpr("*", "'x' AS kind", "1 AS e")
    got = {}
    for r in periods_and_gaps(df, ["k"], block=block).collect():
        got.setdefault(r["k"], set()).add((r["kind"], r["start_pos"], r["end_pos"]))
    want = {k: _periods([(s, e) for j, s, e in rows if j == k and s and e and s <= e]) for k in ("k0", "k1", "k2", "k3", "k4")}
    assert got == want


def test_periods_empty(spark):
    assert periods_and_gaps(spark.createDataFrame([], "k string, start_pos long, end_pos long"), ["k"]).count() == 0


PACKED = [
    (1, "gene_id \"G1\"; tag 'a,b;;c'; note=\"it's; one, two\" | x:y , ;;", [(1, 1, "gene_id", "G1"), (2, 1, "tag", "a"), (2, 2, "tag", "b"), (2, 4, "tag", "c"), (3, 1, "note", "it's; one, two"), (4, 1, "x", "y")]),
    (2, None, []),
    (3, " ; , | ", []),
    (4, "a=\"\"; b=' '; c ?; d:.;e = \" v \"", [(3, 1, "c", "?"), (4, 1, "d", "."), (5, 1, "e", "v")]),
    (5, 'note "says \\"yes; no\\" \\\\"; TAG="p\\,q,r"', [(1, 1, "note", 'says "yes; no" \\'), (2, 1, "tag", "p,q"), (2, 2, "tag", "r")]),
    (6, "a\x01=\x02x\x01b; k=\"\x01o\x02;\"", [(2, 1, "k", "\x01o\x02;")]),
    (7, "note 5' end; z='q'", [(1, 1, "note", "5' end"), (2, 1, "z", "q")]),
    (8, "path c:\\tmp; tag x", [(1, 1, "path", "c:\\tmp"), (2, 1, "tag", "x")]),
    (9, "-; k v; lone", [(2, 1, "k", "v")]),
    (10, "k '" + "\\'" * 30_000 + "'", [(1, 1, "k", "'" * 30_000)]),
]


def test_packed(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t, _ in PACKED] * 2, "row_id long, attributes string, attr_key string")
    got = {}
    for r in unpacked(df, "attributes", ["tag"], ["row_id"]).collect():
        got.setdefault(r["row_id"], []).append((r["pos"], r["item_no"], r["attr_key"], r["attr_value"]))
    for i, text, want in PACKED:
        assert sorted(got.get(i, [])) == sorted(want * 2), text[:80]


def test_packed_empty(spark):
    assert unpacked(spark.createDataFrame([], "row_id long, attributes string"), "attributes", [], ["row_id"]).count() == 0
