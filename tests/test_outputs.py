"""Output forms and helpers on small rows: sizes, neighbours, headers, prepared rows, user operators, matched controls, cut tables."""

import random

import pytest
from locusframe import session
from locusframe.functions import text
from locusframe.model import attr
from locusframe.operators import edit, intervals, select, sequences, signal
from locusframe.registry import listing, load_operators
from locusframe.sources import readers
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    return readers.example(spark, 4, 3).cache()


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a\n b\r\n", [1, 2, 4], ["x", "y", "z"]), (None, [], [])], "t string, n array<int>, w array<string>")
    got = df.select(text.chomp(F.col("t")).alias("a"), text.left_aligned(F.col("t")).alias("b"), text.alphanumeric(F.col("t")).alias("c"), text.neighbours(F.col("n")).alias("d"), text.spoken(F.col("w")).alias("e"), text.evenly(F.lit(0), F.lit(1), 3).alias("f")).collect()
    assert (got[0]["a"], got[0]["b"], got[0]["c"]) == ("  a\n b", "a\nb\r\n", "_a_b_")
    assert [tuple(x) for x in got[0]["d"]] == [(1, 2), (2, 4)] and got[1]["d"] == [] and got[1]["a"] is None
    assert got[0]["e"] == "x, y and z" and got[1]["e"] == "" and got[0]["f"] == [0.0, 0.5, 1.0]


def test_outputs(rows, spark):
    assert rows.count() == 20 and rows.select("rid").distinct().count() == 20
    sized = select.select_by_intron_size(rows, 10, add_size=True).where("feature = 'transcript'")
    assert {r[0] for r in sized.select(attr("intron_size")).collect()} == {"50,50"}
    merged = select.select_by_intron_size(rows, 10, merged=True, add_size=True).where("feature = 'transcript'")
    assert {r[0] for r in merged.select(attr("intron_size")).collect()} == {"100"}
    near = intervals.with_neighbours(rows, intervals.closest_genes(rows, 1, "gene", "gene"))
    assert [r[0] for r in near.where("feature = 'gene'").orderBy("rid").select(attr("closest_gene")).collect()] == ["G0002", "G0001,G0003", "G0002,G0004", "G0003"]
    sizes = spark.createDataFrame([("chr1", 9000)], "chrom string, size long")
    met = intervals.overlapping_transcripts(rows.where("start < 3000"), sizes, upstream=800, downstream=800)
    assert {tuple(r["others"]) for r in met.collect()} == {("G0002T001",), ("G0001T001", "G0003T001"), ("G0002T001",)}
    assert intervals.select_overlapping(rows, met).count() == 12 and intervals.select_overlapping(rows, met, invert=True).count() == 4
    flagged = intervals.annotate_overlapping(rows, met, "o", as_flag=True, every_feature=True)
    assert {r[0]: r[1] for r in flagged.groupBy(attr("o").alias("o")).count().collect()} == {None: 4, "1": 12, "0": 4}
    seqs = spark.createDataFrame([("G0001T001", "acgt"), ("none", "a")], "transcript_id string, sequence string")
    head = {r["transcript_id"]: r["header"] for r in sequences.sequence_headers(seqs, rows, ["gene_id", "seqid"], explicit=True, no_chr=True).collect()}
    assert head == {"G0001T001": "gene_id=G0001|seqid=1", "none": "none"}
    assert sequences.sequence_headers(seqs, rows, [], sleuth=True).where("transcript_id <> 'none'").first()["header"] == "G0001T001 gene:G0001"
    bare = edit.prepared(rows, [], "exon", add_missing=True)
    assert {r["feature"]: r["count"] for r in bare.groupBy("feature").count().collect()} == {"gene": 4, "transcript": 4, "exon": 12}
    kept = select.without_keys(spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int"), spark.createDataFrame([("a",), (None,)], "k string"), "k")
    assert {r["v"] for r in kept.collect()} == {2, 3}
    assert [r["v"] for r in select.sorted_by(kept, "v", descending=True).collect()] == [3, 2]


def test_matched_controls_brute_force(spark):
    rng = random.Random(2)
    people = [("g", f"n{i:03}", float(rng.choice([1, 1, 1, 2, 5, 6, 9])), i % 3 == 0) for i in range(120)]
    rng.shuffle(people)
    pool, want = {n: x for _, n, x, r in people if not r}, []
    for _, name, x, ref in sorted(people, key=lambda p: p[1]):
        if ref and pool:
            best = min(pool, key=lambda n: (abs(pool[n] - x), n))
            want.append((name, best))
            del pool[best]
    df = spark.createDataFrame(people, "group string, gene string, expression double, is_reference boolean")
    assert sorted((r["gene"], r["control"]) for r in signal.matched_controls(df, log=False).collect()) == sorted(want)


def test_user_operators(tmp_path):
    (tmp_path / "own.py").write_text("from locusframe.registry import operator\n\n\n@operator('OWN-1', group='own folder')\ndef doubled(df):\n    \"\"\"Rows twice.\"\"\"\n    return df.unionByName(df)\n")
    assert [o.ids for o in load_operators(str(tmp_path))] == [("OWN-1",)]
    assert ("own folder", "doubled", "Rows twice.") in listing()


def test_cut_tables(spark, monkeypatch):
    one, two = session.cut(spark.range(5)), session.cut(spark.range(7))
    session.drop_cut(one)
    assert spark.read.schema("id long").parquet(one._cut_path).count() == 0 and two.count() == 7
    assert session.drop_cuts(spark) >= 1 and spark.read.schema("id long").parquet(two._cut_path).count() == 0

    class Cluster:
        conf = {"spark.master": "spark://far:7077"}
        sparkContext = None

    monkeypatch.setattr(session, "_LOCAL", {})
    with pytest.raises(ValueError, match="checkpoint"):
        session.checkpoint_folder(Cluster())
