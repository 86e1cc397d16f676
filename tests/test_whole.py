"""Queries over small made-up folders against brute force: no row is left out by a bound that the job doesn't have."""

import importlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

entry = importlib.import_module("__spark_entry__")
FEATURES = pa.schema([("rid", pa.int64()), ("seqid", pa.string()), ("source", pa.string()), ("feature", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("score", pa.string()), ("strand", pa.string()), ("phase", pa.string()), ("gene_id", pa.string()), ("transcript_id", pa.string())])


def feature(rid, kind, start, end, strand="+", gene=None, tx=None, seqid="c1"):
    return (rid, seqid, "t", kind, start, end, ".", strand, ".", gene, tx)


@pytest.fixture
def over(spark, tmp_path):
    """A function: query, rows of `features` and other tables -> the query's rows."""

    def run(name, features, **tables):
        tables = {"features": pa.Table.from_pylist([dict(zip(FEATURES.names, f, strict=True)) for f in features], FEATURES), "seq_size": pa.table({"chrom": ["c1", "c2"], "chrom_size": [10_000_000, 50_000]}), **tables}
        for t, x in tables.items():
            pq.write_table(x, tmp_path / f"{t}.parquet")
        return sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())

    return run


def test_tss_distances_of_catch_all_gene(over):
    rng = random.Random(7)
    genes = ["gxg04200000042"] * 300 + ["g1"] * 5 + ["g2"]
    tx = [feature(i, "transcript", s := rng.randint(1, 400), s + rng.randint(0, 90), "-" if g == "g1" else "+", g, f"t{i:03}") for i, g in enumerate(genes)]
    site = {f[10]: (f[5] if f[7] == "-" else f[4], -f[5] if f[7] == "-" else f[4]) for f in tx}
    pairs, ladder = [], []
    asked = {f[10] for f in tx if f[0] % 20 == 0}
    for g in set(genes):
        own = [f[10] for f in tx if f[9] == g]
        ways = sorted({site[t][1] for t in own})
        ranks = {w: i + 1 for i, w in enumerate(ways)}
        key = {t: (ranks[site[t][1]], t) for t in own}
        pairs += [(g, a, b, abs(site[a][0] - site[b][0]), key[a][0], key[b][0]) for a in own for b in own if key[a] < key[b] and {a, b} & asked]
        place = {ranks[site[t][1]]: site[t][0] for t in own}
        ladder += [(g, t, site[t][0], r, None if r == 1 else abs(site[t][0] - place[r - 1]), abs(site[t][0] - place[1]), sum(key[u][0] > r for u in own)) for t in own for r in [key[t][0]]]
    assert over("agg_07_tss_pairs", tx) == sorted(pairs)
    assert sorted(map(str, over("agg_07_tss_dist", tx))) == sorted(map(str, ladder))


def test_all_genes_are_excluded(over):
    rng = random.Random(9)
    genes = [feature(i, "gene", s := rng.randint(1, 60_000), s + rng.choice((200, 2999, 3000, 9000)), gene=f"g{i}") for i in range(8)]
    exons = [feature(100 + i, "exon", s := rng.randint(1, 70_000), s + rng.randint(0, 4000), gene="g", tx=f"t{i}") for i in range(60)]
    holes = {p for g in genes for p in range(g[4] - 1, g[5])}
    kept = [0]
    for p in range(80_000):
        kept.append(kept[-1] + (p not in holes))
    assert any(g[5] - g[4] >= 3000 for g in genes)
    assert over("iv_22_exclude", genes + exons) == [(x[0], kept[x[4] - 1], kept[x[5]]) for x in exons if kept[x[4] - 1] < kept[x[5]]]


def test_ids_with_version_are_joined(over):
    rows = [feature(i, kind, 1, 90, gene="g", tx=tx) for i, (kind, tx) in enumerate([("transcript", "T1.4"), ("exon", "t1"), ("exon", "t2"), ("gene", None), ("exon", "t.x")])]
    pot = pa.table({"cp_id": [1, 2, 3, 4, 5], "transcript_id": [" T1.2", "t1", "?", "T2.11 ", "t.x"], "mrna_size": pa.array([300, 200, 7, None, 5], pa.int64())})
    assert over("att_04_join", rows, coding_pot=pot) == [(0, "200|300"), (1, "200|300"), (4, "5")]


def letters(start, end, strand="+"):
    bases = "".join("acgtacca"[(p * 7 + p // 3) % 8] for p in range(start, end + 1))
    return bases if strand == "+" else bases[::-1].translate(str.maketrans("acgt", "tgca"))


def test_sequences_along_whole_chromosomes(over):
    spans = [(1, 40), (16_380, 16_390), (1_999_990, 2_000_010), (2_000_100, 2_000_160), (9_000_001, 9_040_000)]
    exons = [feature(10 * k + i, "exon", s, e, strand, f"g{k}", f"t{k}") for k, strand in enumerate("+-") for i, (s, e) in enumerate(spans)]
    joined = {"+": "".join(letters(s, e) for s, e in spans), "-": "".join(letters(s, e, "-") for s, e in reversed(spans))}
    assert over("seq_01_spliced", exons) == [("t0", "g0", "c1", "+", joined["+"]), ("t1", "g1", "c1", "-", joined["-"])]
    assert over("iv_08_fetch", [(*f[:3], "cds", *f[4:]) for f in exons]) == [(f[0], letters(f[4], f[5], f[7])) for f in exons]


def test_overlaps_of_long_transcripts(over):
    rng = random.Random(8)
    rows = [feature(i, kind, s := rng.randint(1, 90_000), s + rng.choice((90, 1998, 1999, 2000, 40_000)), rng.choice("+-"), "g", f"t{i}") for i, kind in enumerate(["transcript", "exon"] * 40)]
    pairs = [(a, b) for a in rows for b in rows if a[3] == "transcript" and b[3] == "exon" and a[4] <= b[5] and b[4] <= a[5]]
    assert any(a[5] - a[4] >= 2000 for a, _ in pairs)
    assert over("iv_03_overlap", rows) == sorted((a[0], b[0], max(a[4], b[4]) - 1, min(a[5], b[5])) for a, b in pairs)
    assert over("iv_03_opposite", rows) == sorted((a[0], b[0]) for a, b in pairs if a[7] != b[7])
