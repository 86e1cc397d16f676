"""Operators on small hand-made rows: statistics, conditions, intervals, editing, signal, sequences, files, streams."""

import bisect
import gzip
import math
import random
import sqlite3
from collections import Counter

import pytest
from compare import differences
from locusframe.functions import conditions
from locusframe.functions.statistics import beta_pvalue, log_beta_tail, negbin_fit_quality, negbin_log10_pvalue
from locusframe.model import attr, bed, with_position
from locusframe.operators import aggregate, blocks, edit, enrichment, intervals, mining, project, select, sequences, signal
from locusframe.registry import apropos, operator, operators
from locusframe.sources import readers, writers
from pyspark.sql import functions as F

GTF = """# a comment
chr1\tt\tgene\t10\t60\t.\t+\t.\tgene_id "g1";
chr1\tt\ttranscript\t10\t60\t7\t+\t.\tgene_id "g1"; transcript_id "t1"; tag "a"; tag "b";

chr1\tt\texon\t10\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; level 3;
chr1\tt\texon\t41\t60\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; level ?;
chr1\tt\ttranscript\t10\t30\t.\t+\t.\tgene_id "g1"; transcript_id "t2";
chr1\tt\texon\t10\t30\t.\t+\t.\tgene_id "g1"; transcript_id "t2";
chr1\tt\tgene\t101\t130\t.\t-\t.\tgene_id "g2";
chr1\tt\ttranscript\t101\t130\t.\t-\t.\tgene_id "g2"; transcript_id "t3";
chr1\tt\texon\t101\t110\t.\t-\t.\tgene_id "g2"; transcript_id "t3";
chr1\tt\texon\t121\t130\t.\t-\t.\tgene_id "g2"; transcript_id "t3";
"""


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("g") / "x.gtf.gz"
    with gzip.open(path, "wt") as f:
        f.write(GTF)
    return readers.ordered(readers.read_annotation(spark, f"file://{path}")).cache()


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame([("chr1", 200)], "chrom string, size long")


def test_statistics():
    assert math.isclose(negbin_log10_pvalue(65630, 18400, 630200), math.log10(1.1999432787236828e-307), rel_tol=1e-6)
    exact = sum(math.comb(k + 4, k) * 0.3**5 * 0.7**k for k in range(8))
    assert math.isclose(math.exp(log_beta_tail(5, 8, 0.3)), exact, rel_tol=1e-10)
    assert math.isclose(math.exp(log_beta_tail(2, 3, 0.9)), 1 - sum(math.comb(4, k) * 0.9**k * 0.1 ** (4 - k) for k in range(2)), rel_tol=1e-10)
    assert log_beta_tail(2, 3, 0) == -math.inf and log_beta_tail(2, 3, 1) == 0
    assert negbin_fit_quality([], 0, 0) == -1 and negbin_fit_quality([100 + i % 20 for i in range(200)], 110, 300) <= 1
    assert beta_pvalue(1, 0, 0, 0, 0) == -1
    assert 0 < beta_pvalue(0.9, 0.5, 1 / 12, 0, -1.2) < 0.11


def test_conditions(rows):
    assert [t for _, t in conditions.tokens("a>=2 and (3 < b)")] == ["a", ">=", "2", "and", "(", "3", "<", "b", ")"]
    for bad in ("a >", "a > b", "a > 1)", "1 > 2", "(a > 1", "a > 1 or", "__import__('x')"):
        with pytest.raises(ValueError):
            conditions.condition(bad, F.col)
    assert select.select_by_number(rows, "level > 2 or level < 0 and start == 1").count() == 1
    with pytest.raises(Exception, match="no number"):
        select.select_by_number(rows, "feature > 2").count()


def test_selection(rows):
    assert select.select_by_key(rows, "feature", "gene").count() == 2
    assert select.select_by_key(rows, "transcript_id", "t1", invert=True).count() == 5
    assert select.select_by_key(rows, "transcript_id", "t1", invert=True, no_na=False).count() == 7
    assert select.select_by_key(rows, "tag", "b").count() == 0
    assert select.select_by_key(rows, "gene_id", [f"x{i}" for i in range(2000)] + ["g2"]).count() == 4
    with pytest.raises(ValueError):
        select.select_by_key(rows, "tag", "*")
    assert [r["rid"] for r in select.select_by_positions(rows, [3, 0, 3]).orderBy("at").collect()] == [3, 0, 3]
    odd = rows.withColumn("rid", F.lit(None).cast("long")).unionByName(rows.limit(1).withColumns({"start": F.lit(400), "end": F.lit(10)}))
    for one in ([("chr1", 1, 12), ("chr2", 1, 500)], [("chr1", 55, 100), ("chr1", 120, 120)]):
        more = one + [("chr1", i, i) for i in range(600, 1200, 3)]
        assert sorted(map(str, select.select_by_location(odd, one).collect())) == sorted(map(str, select.select_by_location(odd, more).collect()))
    many = [("chr1", i, i) for i in range(300, 400)] + [("chr1", 125, 126)]
    assert select.select_by_location(rows, many).count() == select.select_by_location(rows, many[-1:]).count() == 3
    assert {r[0] for r in select.select_by_max_exon_count(rows).select(attr("transcript_id")).distinct().collect()} == {"t1", "t3"}
    assert select.remove_duplicate_tss(rows).where("feature = 'transcript'").count() == 2
    assert select.random_members(rows, 2).select(attr("transcript_id")).distinct().count() == 2
    assert select.select_by_key(rows.limit(0), "feature", "gene").count() == 0
    assert [r["position"] for r in with_position(rows, block=3).orderBy("rid").collect()] == list(range(10))


def test_projection(rows):
    assert [r["key"] for r in project.attribute_names(rows).orderBy("first_rid", "first_pos").collect()] == ["gene_id", "transcript_id", "tag", "level"]
    assert project.extract(rows, ["all"]).columns == ["rid", "seqid", "source", "feature", "start", "end", "score", "strand", "phase", "gene_id", "transcript_id", "tag", "level"]
    assert {r["key"]: r["values"] for r in project.merged_values(rows, "gene_id", "feature").collect()}["g1"] == ["gene", "transcript", "exon"]
    assert [r["level"] for r in project.iterate(rows, ["level"])][2:4] == ["3", "?"]
    assert {r["transcript_id"]: r["tss_rank"] for r in project.transcripts_by_tss(rows).collect()} == {"t1": 1, "t2": 1, "t3": 1}
    assert aggregate.tss_distances(rows).count() == 1


def test_editing(rows, spark):
    assert edit.delete_attributes(rows, ["gene_id"]).where(attr("gene_id").isNull()).count() == 0
    assert edit.delete_attributes(rows, ["gene_id"], force=True).where(attr("gene_id").isNull()).count() == 10
    pairs = spark.createDataFrame([("g1", "b"), ("g1", "a"), (None, "c"), ("g2", None)], "key string, value string")
    joined = edit.join_attribute(rows, pairs, "gene_id", "extra", features="gene")
    assert [r[0] for r in joined.orderBy("rid").select(attr("extra")).where(F.col("feature") == "gene").collect()] == ["a|b", None]
    with pytest.raises(ValueError):
        edit.discretize(rows, "level", "x", 2)
    added = edit.to_ensembl(rows.where("feature = 'exon'"))
    assert sorted((r["feature"], r["start"], r["end"]) for r in added.where("feature <> 'exon'").collect()) == [("gene", 10, 60), ("gene", 101, 130), ("transcript", 10, 30), ("transcript", 10, 60), ("transcript", 101, 130)]


def test_intervals(rows, sizes, spark):
    def got(df, *columns):
        return sorted(tuple(r[c] for c in columns) for r in df.collect())

    one = spark.createDataFrame([(1, "chr1", 0, 100, "a", "."), (2, "chr1", 0, 101, "b", "."), (3, "chr1", 5, 5, "c", ".")], "rid long, chrom string, start long, end long, name string, strand string")
    assert got(intervals.midpoints(one.where("rid < 3")), "start", "end") == [(49, 51), (50, 51)]
    spans = spark.createDataFrame([("c", 1, 5), ("c", 5, 8), ("c", 2, 3), ("c", 10, 12)], "chrom string, start long, end long")
    assert got(intervals.merge(spans), "start", "end") == [(1, 8), (10, 12)]
    assert got(intervals.introns(rows), "transcript_id", "start", "end", "number") == [("t1", 20, 40, 1), ("t3", 110, 120, 1)]
    assert got(intervals.introns(rows, by_transcript=False), "start", "end") == [(30, 40), (110, 120)]
    assert got(intervals.intergenic(rows, sizes), "start", "end") == [(0, 9), (60, 100), (130, 200)]
    assert got(intervals.closest_genes(rows), "gene", "neighbour", "distance") == [("g1", "g2", 120), ("g2", "g1", 120)]
    with pytest.raises(Exception, match="without strand"):
        intervals.ends(rows.withColumn("strand", F.lit("."))).collect()
    sets = [spark.createDataFrame(x, "chrom string, start long, end long") for x in ([("c", 100, 200), ("c", 300, 400)], [("c", 150, 250), ("c", 350, 380)], [("c", 180, 200)])]
    assert got(intervals.sweep(sets), "start", "end", "flags") == [(150, 180, [1, 1, 0]), (180, 200, [1, 1, 1]), (350, 380, [1, 1, 0])]
    gaps = intervals.lengths_and_gaps(spark.createDataFrame([("chr1", 10, 15), ("chr1", 40, 50)], "chrom string, start long, end long"), spark.createDataFrame([("chr1", 300)], "chrom string, size long"))
    assert got(gaps, "number", "gap") == [(1, 10), (2, 25), (3, 250)]
    cut = intervals.exclude_concatenate(one.where("rid = 1"), spark.createDataFrame([("chr1", 10, 20), ("chr1", 15, 30), ("chr1", 90, 200)], "chrom string, start long, end long"))
    assert got(cut, "start", "end") == [(0, 70)]
    assert intervals.merge(spans.limit(0)).count() == 0 and intervals.closest(one.limit(0), one).count() == 0


def test_closest_with_repeated_names(spark):
    rng = random.Random(4)
    schema = "rid long, chrom string, start long, end long, name string, strand string"
    rows = [(i, rng.choice("cd"), s := rng.randint(0, 400), s + rng.randint(1, 9), rng.choice(["n"] * 12 + ["a", "b", "x", None]), rng.choice("++-.")) for i in range(140)]
    rows += [(200 + i, "e", 100 * i, 100 * i + 5, "n", "+") for i in range(40)] + [(300, "e", 9000, 9001, "m", "+"), (301, "e", 9500, 9501, "n", "-")]
    df = spark.createDataFrame(rows, schema)

    def gap(a, b):
        return 0 if a[2] < b[3] and b[2] < a[3] else a[2] - b[3] + 1 if b[3] <= a[2] else b[2] - a[3] + 1

    for k, strand, other in ((1, "any", True), (3, "same", True), (2, "opposite", True), (2, "any", False)):
        want = set()
        for a in rows:
            near = [(gap(a, b), b[0]) for b in rows if a[1] == b[1] and (not other or (a[4] and b[4] and a[4] != b[4]))
                    and (strand == "any" or ("." not in a[5] + b[5] and (a[5] == b[5]) == (strand == "same")))]
            want |= {(a[0], r, d) for d, r in near if sum(x < d for x, _ in near) < k}
        got = [(r["rid"], r["rid_b"], r["distance"]) for r in intervals.closest(df, df, k, strand, other).collect()]
        assert len(got) == len(set(got)) and set(got) == want, (k, strand, other)
    for downstream in (False, True):
        got = {(r["rid"], r["distance"]) for r in intervals.next_beside(df, df, downstream).collect()}
        want = set()
        for a in rows:
            left = (a[5] == "-") == downstream
            gaps = [a[2] - b[3] + 1 if left else b[2] - a[3] + 1 for b in rows if a[1] == b[1] and (b[3] <= a[2] if left else b[2] >= a[3])]
            want.add((a[0], min(gaps, default=-1)))
        assert got == want


def test_one_hot_chromosome(spark, monkeypatch):
    """Blocks far smaller than the data: what is carried from block to block must add up."""
    rng = random.Random(6)
    monkeypatch.setattr(blocks.block_of, "__defaults__", (64,))
    for f in (blocks.summed_before, blocks.ranked_places, blocks.rank_upto):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 64))
    monkeypatch.setattr(intervals.periods_and_gaps, "__defaults__", (*intervals.periods_and_gaps.__defaults__[:-1], 64))
    monkeypatch.setattr(enrichment, "PERMUTED", 8)
    monkeypatch.setattr(enrichment, "BLOCK", 8)
    spans = [("hot", s := rng.randint(0, 3000), s + rng.randint(1, 30)) for _ in range(150)] + [("cold", 5, 9), ("cold", 20, 30)]
    df = spark.createDataFrame(spans, "chrom string, start long, end long")
    sizes = spark.createDataFrame([("hot", 4000), ("cold", 50), ("bare", 7)], "chrom string, size long")
    held = {c: sorted({p for d, s, e in spans if d == c for p in range(s, e)}) for c in ("hot", "cold", "bare")}

    def runs(points):
        out = []
        for p in points:
            if out and out[-1][1] == p:
                out[-1][1] = p + 1
            else:
                out.append([p, p + 1])
        return [tuple(x) for x in out]

    merged = intervals.merge(df)
    assert sorted((r["start"], r["end"]) for r in merged.where("chrom = 'hot'").collect()) == runs(held["hot"])
    lengths = [(r["length"], r["gap"]) for r in intervals.lengths_and_gaps(merged, sizes).where("chrom = 'hot'").orderBy("number").collect()]
    want, at = [], 0
    for s, e in runs(held["hot"]):
        want.append((e - s, s - at))
        at = e
    assert lengths == [*want, (None, 4000 - at)]
    free = {c: runs([p for p in range(n) if p not in set(held[c])]) for c, n in (("hot", 4000), ("cold", 50), ("bare", 7))}
    got = enrichment.complement(df, sizes).collect()
    assert {c: sorted((r["start"], r["end"]) for r in got if r["chrom"] == c) for c in free} == free
    kept = [p for p in range(4000) if p not in set(held["hot"])]
    moved = intervals.exclude_concatenate(spark.createDataFrame([("hot", s, s + 100) for s in range(0, 3900, 37)], "chrom string, start long, end long"), df)
    cut = [(bisect.bisect_left(kept, s), bisect.bisect_left(kept, s + 100)) for s in range(0, 3900, 37)]
    assert sorted((r["start"], r["end"]) for r in moved.collect()) == sorted(x for x in cut if x[0] < x[1])
    drawn = enrichment.shuffled(merged, sizes, 3).where("chrom = 'hot'").collect()
    for i in range(3):
        one = sorted((r["start"], r["end"]) for r in drawn if r["shuffle"] == i)
        assert sorted(e - s for s, e in one) == sorted(n for n, _ in want)
        gaps = [s - e for (_, e), (s, _) in zip([(0, 0), *one], one)]
        assert not Counter(gaps) - Counter([*(g for _, g in want), 4000 - at]) and one != runs(held["hot"])


def test_enrichment_driver(rows, sizes, spark):
    query = spark.createDataFrame([("chr1", 15, 25), ("chr1", 105, 115), ("chrX", 1, 9)], "chrom string, start long, end long")
    own = {"mine": spark.createDataFrame([("chr1", 0, 20), ("chr1", 60, 70)], "chrom string, start long, end long")}
    stats = {r["feature_type"]: r for r in enrichment.annotation_enrichment(query, rows, sizes, 5, 5, more_keys=("tag",), more_sets=own, shuffles=4).collect()}
    assert set(stats) == {"gene", "transcript", "exon", "Intergenic", "Introns", "Promoters", "Terminator", "tag:a", "mine"}
    assert {k: (v["nb_intersections_true"], v["summed_bp_overlaps_true"]) for k, v in stats.items()}["exon"] == (2, 15)
    assert stats["Introns"]["summed_bp_overlaps_true"] == 5 and stats["mine"]["summed_bp_overlaps_true"] == 5
    few = enrichment.annotation_enrichment(query.limit(1), rows, sizes, shuffles=10).first()
    assert few["summed_bp_overlaps_pvalue"] == few["nb_intersections_negbinom_fit_quality"] == -1 and few["summed_bp_overlaps_true"] == 0
    rest = enrichment.annotation_enrichment(query, None, sizes, more_sets=own, shuffles=2, included=spark.createDataFrame([("chr1", 18, 200)], "chrom string, start long, end long")).first()
    assert rest["summed_bp_overlaps_true"] == 2
    with pytest.raises(ValueError):
        enrichment.annotation_enrichment(query, None, sizes)
    found = {r["combination"]: (r["nb_intersections_true"], r["summed_bp_overlaps_true"]) for r in enrichment.combination_enrichment(query, {"A": own["mine"], "B": bed(rows)}, sizes, 2, combinations=[(1, 1, 0), (1, 1, 1), (1, 0, 1)]).collect()}
    assert found == {"[Query + A + ... ]": (1, 5), "[Query + A + B + ... ]": (1, 5), "[Query + B + ... ]": (2, 20)}
    with pytest.raises(Exception, match="fewer than 3"):
        enrichment.markov_shuffled(query, sizes, 2).collect()
    many = spark.createDataFrame([("chr1", 9000 * i, 9000 * i + 500 * (i % 5 + 1)) for i in range(40)], "chrom string, start long, end long")
    drawn = enrichment.markov_shuffled(many, sizes, 3).collect()
    assert len(drawn) == 120 and all(0 < r["end"] - r["start"] <= 3000 for r in drawn)
    flags = spark.createDataFrame([([1, 1, 0, 0],)] * 1000 + [([0, 0, 1, 1],)] * 100, "flags array<int>")
    assert {tuple(r["pattern"]): r["weight"] for r in mining.squished(flags).collect()} == {(1, 1, 0, 0): 4, (0, 0, 1, 1): 1}
    rare = spark.createDataFrame([([1, 0],)] * 40_000 + [([0, 1],)], "flags array<int>")
    assert {tuple(r["pattern"]): r["weight"] for r in mining.squished(rare).collect()} == {(1, 0): 100, (0, 1): 1}
    run = spark.createDataFrame([("e", 200, 10.0, 4.0, 12, 100.0, 400.0, 90), ("e", 200, 12.0, 6.0, 12, 80.0, 300.0, 90)], "k string, n_shuffles int, nb_intersections_expectation_shuffled double, nb_intersections_variance_shuffled double, nb_intersections_true int, summed_bp_overlaps_expectation_shuffled double, summed_bp_overlaps_variance_shuffled double, summed_bp_overlaps_true int")
    both = enrichment.merged_runs(run, ["k"]).first()
    assert both["n_shuffles"] == 400 and both["nb_intersections_expectation_shuffled"] == 11
    assert math.isclose(both["summed_bp_overlaps_log10_pvalue"], negbin_log10_pvalue(90, 90, both["summed_bp_overlaps_variance_shuffled"]))
    assert [r["minus_log10_pvalue"] for r in enrichment.stacked_runs({"a": spark.createDataFrame([(0.0,), (0.01,), (-1.0,)], "summed_bp_overlaps_pvalue double")}).collect()] == [320.0, 2.0, None]
    tree = {("+".join(r["parent"]), "+".join(r["child"])) for r in enrichment.combination_tree(spark.createDataFrame([(["A"], 10), (["A", "B"], 5), (["A", "B", "C"], 2), (["D"], 4)], "sets array<string>, s long")).collect()}
    assert tree == {("A", "A+B"), ("A+B", "A+B+C"), ("Query", "A"), ("Query", "D")}


def test_signal_and_enrichment(rows, sizes, spark):
    track = spark.createDataFrame([("s", "chr1", 9, 19, 2.0), ("s", "chr1", 100, 130, 1.0)], "track string, chrom string, start long, end long, value double")
    genes = bed(rows.where("feature = 'gene'"))
    values = {(r["rid"], r["bin"]): r["value"] for r in signal.binned_signal(genes, track, ["s"], 3, stranded=True).collect()}
    assert values == {(0, 0): round(20 / 17, 6), (0, 1): 0.0, (0, 2): 0.0, (6, 0): 1.0, (6, 1): 1.0, (6, 2): 1.0}
    assert {r["rid"]: r["cov"] for r in signal.coverage(genes, track, ["s"], 1000).collect()} == {0: 1.0, 6: 1.0}
    assert [(r["start"], r["end"]) for r in signal.signal_runs(track, "s >= 2").collect()] == [(9, 19)]
    people = spark.createDataFrame([("x", "a", 5.0, True), ("x", "b", 5.0, False), ("x", "c", 4.0, False), ("x", "d", 6.0, True), ("x", "e", 6.0, False), ("x", None, 1.0, False)], "group string, gene string, expression double, is_reference boolean")
    assert sorted(tuple(r) for r in signal.matched_controls(people, log=False).collect()) == [("x", "a", "b"), ("x", "d", "e")]
    exons = bed(rows.where("feature = 'exon'"))
    true = enrichment.true_overlap(genes, exons).first()
    assert (true["n"], true["s"]) == (4, 61)
    runs = enrichment.shuffle_overlaps(genes, exons.withColumn("k", F.lit("e")), sizes, 6, keys=("k",))
    assert runs.count() == 6 and runs.agg(F.min("s")).first()[0] >= 0
    stats = enrichment.enrichment(runs, enrichment.true_overlap(genes, exons.withColumn("k", F.lit("e")), ("k",)), ["k"]).first()
    assert stats["summed_bp_overlaps_true"] == 61 and -1 <= stats["summed_bp_overlaps_pvalue"] <= 1
    assert enrichment.shuffle_overlaps(genes.limit(0), exons, sizes, 3).agg(F.sum("n")).first()[0] == 0
    flags = spark.createDataFrame([([1, 1, 0],), ([1, 1, 1],), ([1, 1, 0],), ([0, 0, 1],)], "flags array<int>")
    patterns = mining.squished(flags)
    assert {tuple(r["pattern"]): r["n"] for r in patterns.collect()} == {(1, 1, 0): 2, (1, 1, 1): 1, (0, 0, 1): 1}
    assert mining.best_dictionary(patterns, [(1, 1, 0), (0, 0, 1), (1, 0, 0)], 2)[0][0] == (1, 1, 0)
    assert mining.candidate_words(patterns.limit(0), 3) == []


def test_sequences(rows, spark):
    text = "".join("acgt"[(i * i + i // 3) % 4] for i in range(200))
    genome = sequences.chunked(spark.createDataFrame([("chr1", text), ("chr2", "")], "chrom string, sequence string"), 16)
    rc = str.maketrans("acgt", "tgca")
    got = {r["transcript_id"]: r["sequence"] for r in sequences.transcript_sequences(rows, genome, chunk=16).collect()}
    assert got == {"t1": text[9:20] + text[40:60], "t2": text[9:30], "t3": (text[100:110] + text[120:130])[::-1].translate(rc)}
    spans = {r["transcript_id"]: r["sequence"] for r in sequences.transcript_sequences(rows, genome, with_introns=True, chunk=16).collect()}
    assert spans["t1"] == text[9:60]
    assert [(r["first"], r["last"]) for r in sequences.exon_offsets(rows).where("transcript_id = 't3'").orderBy("first").collect()] == [(1, 10), (11, 20)]
    line = sequences.fasta_lines(spark.createDataFrame([("a", "x" * 130)], "n string, sequence string"), ["n"]).first()[0]
    assert [len(x) for x in line.split("\n")] == [2, 60, 60, 10]


def test_files(rows, spark, tmp_path):
    here = f"file://{tmp_path}"
    writers.write_annotation(rows, f"{here}/out", one_file=True)
    again = readers.ordered(readers.read_annotation(spark, f"{here}/out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    writers.write_bed(rows, f"{here}/bed", ["transcript_id"], one_file=True)
    back = readers.read_bed(spark, f"{here}/bed")
    assert back.count() == 10 and back.where("name = '?'").count() == 2
    (tmp_path / "bad.gtf").write_text("chr1\tonly\n")
    with pytest.raises(Exception, match="not nine columns"):
        readers.read_annotation(spark, f"{here}/bad.gtf").collect()
    assert readers.read_annotation(spark, f"{here}/bad.gtf", strict=False).count() == 0
    (tmp_path / "three.bed").write_text("track x\nchr1\t1\t5\nchr1\t7\t9\n")
    assert [(r["score"], r["strand"], r["name"][:7]) for r in readers.read_bed(spark, f"{here}/three.bed").collect()] == [("0", ".", "region_")] * 2
    (tmp_path / "sizes").write_text("# c\nchrom\tsize\nchr1\t300\nchrUn_1\t5\n")
    assert [tuple(r) for r in readers.read_sizes(spark, f"{here}/sizes", drop_odd=True).collect()] == [("chr1", 300)]
    (tmp_path / "g.fa").write_text(">chr1 x\nAC\nGT\n>chr2\nTT\n")
    assert {tuple(r) for r in readers.read_fasta(spark, f"{here}/g.fa").collect()} == {("chr1", "ACGT"), ("chr2", "TT")}
    (tmp_path / "t.bg").write_text("chr1\t0\t5\t1.5\n")
    assert readers.read_track(spark, f"{here}/t.bg", "t").first()["value"] == 1.5
    (tmp_path / "m.tsv").write_text("genes\tS1\tS2\ng1\t1\t2\n")
    assert readers.read_matrix(spark, f"{here}/m.tsv").first().asDict() == {"genes": "g1", "S1": "1", "S2": "2"}
    (tmp_path / "p.tsv").write_text("0\tAAA\n3\tB\n")
    assert edit.join_by_position(rows, readers.read_positions(spark, f"{here}/p.tsv"), "k").where(attr("k").isNotNull()).count() == 2
    (tmp_path / "c.tsv").write_text("\n".join("?x0123456789"[1:]) + "\n")
    assert edit.join_by_position(rows, readers.read_positions(spark, f"{here}/c.tsv"), "k").where(attr("k") == "0").first()["rid"] == 1
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE GeneTable (a, b)")
        db.executemany("INSERT INTO GeneTable VALUES (?, ?)", [(1, "x"), (2, None)])
    db.close()
    assert readers.sqlite_tables(f"{tmp_path}/x.db") == ["GeneTable"]
    assert [tuple(r) for r in readers.read_sqlite(spark, f"{tmp_path}/x.db", "GeneTable").orderBy("a").collect()] == [("1", "x"), ("2", None)]
    with pytest.raises(ValueError):
        readers.read_sqlite(spark, f"{tmp_path}/x.db", "a; DROP")
    (tmp_path / "h.tsv").write_text("q1\tchr1\t99\t10\t0\t0\t1\t10\t60\t51\t1e-5\t50\n")
    hit = readers.read_hits(spark, f"{here}/h.tsv").first()
    assert (hit["seqid"], hit["start"], hit["end"], hit["strand"], hit["feature"]) == ("chr1", 51, 60, "-", "HSP")
    (tmp_path / "mk.tsv").write_text("#ft:promoter;bins:2\nid\tb1\nx\t1\n")
    table, config = readers.read_signal_matrix(spark, f"{here}/mk.tsv")
    assert config == {"ft": "promoter", "bins": "2"} and table.count() == 1
    assert readers.chosen_release_file(["a.gtf.gz", "a.abinitio.gtf.gz", "a.chr.gtf.gz"]) == "a.chr.gtf.gz"
    assert readers.chosen_release_file(["x.txt"]) is None


def test_stream(spark, tmp_path):
    from locusframe.streaming.ingest import line_stream, quarantine_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gtf").write_text(GTF + "broken\n")
    here = f"file://{tmp_path}"
    quarantine_stream(line_stream(spark, f"{here}/in"), f"{here}/good", f"{here}/bad", f"{here}/progress").awaitTermination()
    (tmp_path / "in" / "b.gtf").write_text("x\ty\n")
    quarantine_stream(line_stream(spark, f"{here}/in"), f"{here}/good", f"{here}/bad", f"{here}/progress").awaitTermination()
    assert spark.read.parquet(f"{here}/good").count() == 10
    assert sorted(r["raw_line"] for r in spark.read.parquet(f"{here}/bad").collect()) == ["broken", "x\ty"]


def test_registry():
    assert len(operators()) > 80 and any("SEL-01" in o.ids for o in apropos("sel-01"))

    @operator("MY-1", group="own")
    def mine(df):
        """An operator of one's own."""
        return df

    assert operators("own")[0].function is mine


NAMES = ["p1_found", "p3_found", "p4_found", "p5_found", "p6_found", "sel_08_numeric", "att_10_discretize", "iv_06_closest", "iv_21_regulatory"]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    from pathlib import Path

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test data here")
    assert differences(entry.queries()[name](spark, folder), entry.oracle_sql()[name], folder) == ""
