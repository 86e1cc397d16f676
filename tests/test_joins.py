"""Tables that grow with the work are not broadcast, whatever size Spark takes them for."""

import re

import numpy as np
from locusframe.model import attrs_of, bed
from locusframe.operators import enrichment, intervals, sequences
from locusframe.plans import statistics
from locusframe.session import cut
from locusframe.sources import readers, writers
from pyspark.sql import functions as F


def broadcast(df, key):
    """Broadcast joins by this key in the plan of df."""
    return re.findall(rf"BroadcastHashJoin \[[^\]]*\b{key}#.*", df._jdf.queryExecution().sparkPlan().toString())


def test_shuffled_parts_are_not_broadcast(spark):
    regions = spark.createDataFrame([("a", 10 * i, 10 * i + 3) for i in range(50)], "chrom string, start bigint, end bigint")
    drawn = enrichment.shuffled(regions, spark.createDataFrame([("a", 1000)], "chrom string, size bigint"), 5)
    assert not broadcast(drawn, "shuffle")
    sums = drawn.groupBy("shuffle").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("s"))
    assert sums.select("n", "s").distinct().collect() == [(50, 150)]


def test_genomes_are_not_broadcast(spark):
    text = "ACGT" * 12
    genome = spark.range(3).select(F.lit("a").alias("chrom"), F.col("id").alias("chunk"), F.lit("ACGT" * 4).alias("bases"))
    asked = spark.createDataFrame([(i, "a", i, i + 20, "+") for i in range(20)], "rid bigint, chrom string, start bigint, end bigint, strand string")
    found = sequences.fetch(asked, genome, chunk=16)
    assert not broadcast(found, "chunk") and not broadcast(found, "rid")
    assert {r["rid"]: r["bases"] for r in found.collect()} == {i: text[i : i + 20] for i in range(20)}


def test_spliced_bases_are_shuffled_once(spark):
    genome = spark.range(3).select(F.lit("a").alias("chrom"), F.col("id").alias("chunk"), F.lit("ACGT" * 4).alias("bases"))
    exons = spark.createDataFrame([(1, 21, 40, "t"), (2, 3, 18, "t"), (3, 47, 60, "t"), (4, 49, 60, "u")], "rid bigint, start bigint, end bigint, t string")
    rows = exons.select("rid", F.lit("a").alias("seqid"), F.lit("exon").alias("feature"), "start", "end", F.lit("-").alias("strand"), attrs_of(transcript_id=F.col("t")).alias("attrs"))
    found = sequences.transcript_sequences(rows, genome, chunk=16)
    assert not broadcast(found, "chunk") and found._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
    text = "ACGT" * 12
    spliced = text[2:18] + text[20:40] + text[46:]
    assert [(r["transcript_id"], r["gene_id"], r["sequence"]) for r in found.collect()] == [("t", None, spliced[::-1].translate(str.maketrans("ACGT", "TGCA")))]


def test_compressed_fasta_is_read_back(spark, tmp_path):
    made = spark.createDataFrame([("t", "ACGT" * 40), ("u", "G")], "chrom string, sequence string")
    writers.write_fasta(made, f"file://{tmp_path}/f", ["chrom"], compression="gzip")
    assert all(p.name.endswith(".gz") for p in (tmp_path / "f").glob("part-*"))
    assert sorted(map(tuple, readers.read_fasta(spark, f"file://{tmp_path}/f").collect())) == [("t", "ACGT" * 40), ("u", "G")]


def counted(a, b):
    """Overlaps of two lists of intervals base by base: runs of bases in both, and their number."""
    both = sorted({p for s, e in a for p in range(s, e)} & {p for s, e in b for p in range(s, e)})
    return sum(p - 1 not in set(both) for p in both), len(both)


def test_overlaps_drawn_within_tasks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    for _ in range(200):
        many = (8, rng.integers(1, 9))
        lengths, gaps = ([rng.integers(least, 6, n) for n in many] for least in (1, 0))
        a, b = (enrichment._drawn(x, np.append(y, 3), rng) for x, y in zip(lengths, gaps, strict=True))
        assert (a[1] - a[0]).sum() == lengths[0].sum() and (a[0][1:] > a[1][:-1]).all() and a[0][0] >= 0
        assert enrichment._met(a, b) == counted(*(list(zip(*(v.tolist() for v in x), strict=True)) for x in (a, b)))
    sizes = spark.createDataFrame([("a", 1000), ("b", 400), ("c", 9)], "chrom string, size bigint")
    own = spark.createDataFrame([("a", 10 * i, 10 * i + 3) for i in range(60)] + [("b", 0, 30), ("b", 50, 60), ("d", 1, 2)], "chrom string, start bigint, end bigint")
    sets = spark.createDataFrame([("all", "a", 0, 1000), ("all", "b", 0, 400), ("one", "b", 0, 400), ("none", "c", 0, 9)], "k string, chrom string, start bigint, end bigint")
    # Sets that fill their chromosomes meet all of a wherever it is drawn: in tasks, by the sweep, and part by part.
    for within, drawn in ((1 << 22, 1 << 23), (1, 1 << 23), (10, 1 << 23), (1 << 22, 100)):
        monkeypatch.setattr(enrichment, "WITHIN", within)
        monkeypatch.setattr(enrichment, "DRAWN", drawn)
        found = enrichment.shuffle_overlaps(own, sets, sizes, 6, keys=("k",)).collect()
        assert sorted((r["k"], r["shuffle"], r["s"]) for r in found) == [(k, i, s) for k, s in (("all", 220), ("none", 0), ("one", 40)) for i in range(6)]
        assert all(1 <= r["n"] <= {"all": 62, "one": 2}[r["k"]] for r in found if r["k"] != "none")


def test_enrichment_writes_no_shuffled_sets(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("shuffled sets are written")

    monkeypatch.setattr(enrichment, "shuffled", refused)
    rows = spark.createDataFrame([(i, "a", f, 40 * i + 1, 40 * i + 20, "+" if i % 2 else "-") for i in range(20) for f in ("cds", "exon")], "rid bigint, seqid string, feature string, start bigint, end bigint, strand string")
    rows = rows.withColumns({"attrs": attrs_of(gene_id=F.lit("g")), "score": F.lit(".")})
    query = bed(rows.where("feature = 'cds'"))
    found = enrichment.annotation_enrichment(query, rows, spark.createDataFrame([("a", 2000)], "chrom string, size bigint"), more_keys=("strand",)).collect()
    assert {r["feature_type"]: (r["nb_intersections_true"], r["summed_bp_overlaps_true"]) for r in found} == {"cds": (20, 400), "exon": (20, 400), "strand:+": (10, 200), "strand:-": (10, 200)}
    # As many bases are expected as lie in both of two sets of 20 whose gaps, the last one long, are in any order.
    rng, gaps = np.random.default_rng(3), [0, *[20] * 19, 1220]

    def held():
        return {p for at in np.cumsum(rng.permutation(gaps)[:20] + 20).tolist() for p in range(at - 20, at)}

    seen = np.array([len(held() & held()) for _ in range(1000)])
    exon = next(r for r in found if r["feature_type"] == "exon")
    assert abs(exon["summed_bp_overlaps_expectation_shuffled"] - seen.mean()) < 5 * seen.std() / 200**0.5
    assert 0.6 < exon["summed_bp_overlaps_variance_shuffled"] / seen.var() < 1.6


def test_stacked_runs_of_one_enrichment(spark, monkeypatch):
    monkeypatch.setattr(enrichment, "shuffled", None)  # nothing shuffled is written
    rows = spark.createDataFrame([(i, "a", "cds", 40 * i + 1, 40 * i + 20, "+", ".") for i in range(20)], "rid bigint, seqid string, feature string, start bigint, end bigint, strand string, score string")
    found = statistics._stacked(rows.withColumn("attrs", attrs_of(gene_id=F.lit("g"))), spark.createDataFrame([("a", 2000)], "chrom string, size bigint")).collect()
    runs = {n: sorted((r["feature_type"], r["summed_bp_overlaps_true"], r["minus_log10_pvalue"]) for r in found if r["run"] == n) for n in ("first", "second")}
    assert runs["first"] == runs["second"] and [x[:2] for x in runs["first"]] == [("cds", 400), ("strand:+", 400)]


def test_annotation_sets_are_not_broadcast(spark):
    tx = spark.createDataFrame([(i, "a", 100 * i, 100 * i + 80) for i in range(30)], "rid bigint, chrom string, start bigint, end bigint")
    exons = tx.select("chrom", (F.col("start") + 10).alias("start"), (F.col("start") + 30).alias("end"))
    left = intervals.subtract(tx, exons)
    assert not broadcast(left, "__bin") and not broadcast(left, "rid")
    assert sorted((r["rid"], r["start"], r["end"]) for r in left.collect()) == [(i, 100 * i + s, 100 * i + e) for i in range(30) for s, e in ((0, 10), (30, 80))]
    merged = intervals.merge(tx.unionByName(exons, allowMissingColumns=True))
    assert not broadcast(merged, "block") and merged.count() == 30
    parts = intervals.lengths_and_gaps(merged, spark.createDataFrame([("a", 5000)], "chrom string, size bigint"))
    assert not broadcast(parts, "__block")
    assert [(r["length"], r["gap"]) for r in parts.orderBy("number").collect()] == [(80, 0), *[(80, 20)] * 29, (None, 2020)]


def test_a_query_is_not_broadcast_for_its_sets(spark):
    own = spark.createDataFrame([(c, s, s + 10) for c in "ab" for s in (-(1 << 21), *range(0, 40 << 20, 1 << 20))], "chrom string, start bigint, end bigint")
    sets = spark.createDataFrame([(k, c, 0, 1 << 26) for k, c in ("xa", "ya", "yb")] + [("z", "c", 0, 9)], "k string, chrom string, start bigint, end bigint")
    own, sets = cut(own), cut(sets)  # tables whose size Spark knows
    each = enrichment._for_each_set(own, sets, ("k",))
    assert not broadcast(each, "chrom")
    assert sorted(map(tuple, each.select("k", "chrom", "start", "end").collect())) == sorted((k, *r) for k, c in ("xa", "ya", "yb") for r in map(tuple, own.collect()) if r[0] == c)
    segments = intervals.sweep([each, sets], ["k"])
    assert not broadcast(segments, "block")
    found = enrichment.true_overlap(own, sets, ("k",))
    assert sorted(map(tuple, found.collect())) == [("x", 40, 400), ("y", 80, 800), ("z", 0, 0)]
