"""Queries that write files and read them again, in the shared checkpoint folder, and the SQL of what must come back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import text as T
from locusframe.model import annotation, attr, bed
from locusframe.operators import select as S
from locusframe.operators import sequences as Q
from locusframe.operators.project import extract
from locusframe.plans.annotation import BASE
from locusframe.plans.intervals import SIZES, sizes
from locusframe.plans.statistics import SIGNAL, genome, signal
from locusframe.session import checkpoint_folder, table
from locusframe.sources import readers as R
from locusframe.sources import writers as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    """Register a function (session, data folder, path to write to) under a name, with SQL that follows the definitions."""

    def register(function: Callable[[SparkSession, str, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: function(spark, folder, f"{checkpoint_folder(spark)}/locusframe/files-{uuid.uuid4().hex}")
        ORACLE[name] = f"WITH {BASE}, {SIZES}, {SIGNAL} {sql}"
        return function

    return register


@query("src_01_annotation", "SELECT seqid, feature, s AS start, e AS end, coalesce(strand, '.') AS strand, gene AS gene_id, tx AS transcript_id FROM f")
def annotation_files(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Annotation text, written and read again."""
    W.write_annotation(annotation(spark, folder), path)
    return R.read_annotation(spark, path).select("seqid", "feature", "start", "end", "strand", attr("gene_id").alias("gene_id"), attr("transcript_id").alias("transcript_id"))


@query("src_05_bed", "SELECT seqid AS chrom, s - 1 AS start, e AS end, coalesce(tx, '?') AS name, coalesce(strand, '.') AS strand FROM f")
def interval_files(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Interval text of 6 columns, written and read again."""
    W.write_bed(annotation(spark, folder), path, ["transcript_id"])
    return R.read_bed(spark, path).select("chrom", "start", "end", "name", "strand")


@query("snk_04_ends", "SELECT seqid AS chrom, CASE WHEN strand = '-' THEN s ELSE e END - 1 AS start, coalesce(tx, '.') AS name FROM f WHERE feature = 'transcript' AND strand IN ('+', '-')")
def end_files(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """3' ends of transcripts, written and read again."""
    W.write_ends(annotation(spark, folder).where(F.col("strand").isin("+", "-")), path, three_prime=True)
    return R.read_bed(spark, path).select("chrom", "start", "name")


@query("src_06_sizes", "SELECT chrom, size FROM z")
def size_files(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Sizes of sequences, written and read again."""
    W.write_table(sizes(spark, folder), path)
    return R.read_sizes(spark, path)


@query("src_08_track", "SELECT 'plus' AS track, chrom, b AS start, e AS end, val AS value FROM v WHERE track = 'plus'")
def track_files(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """A numeric track as four-column text, written and read again."""
    W.write_table(signal(annotation(spark, folder)).where("track = 'plus'").select("chrom", "start", "end", "value"), path, header=False)
    return R.read_track(spark, path, "plus")


@query("src_09_fasta", "SELECT tx AS chrom, CAST(sum(e - s + 1) AS BIGINT) AS n FROM f WHERE feature = 'exon' AND tx IS NOT NULL GROUP BY tx, gene, seqid, strand")
def sequence_files(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Spliced transcripts as compressed FASTA text, written and read again: their lengths."""
    rows = annotation(spark, folder)
    spliced = Q.transcript_sequences(rows, genome(bed(rows.where("feature = 'exon'"), ["transcript_id"])))
    W.write_fasta(spliced, path, ["transcript_id"], compression="gzip")
    return R.read_fasta(spark, path).select("chrom", F.length("sequence").cast("bigint").alias("n"))


@query("src_10_pairs", "SELECT DISTINCT gene AS key, feature AS value FROM f WHERE gene IS NOT NULL")
def pair_files(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Keys and values, written and read again."""
    W.write_table(annotation(spark, folder).select(attr("gene_id").alias("key"), F.col("feature").alias("value")).where("key IS NOT NULL").distinct(), path, header=False)
    return R.read_pairs(spark, path)


@query("src_11_matrix", "SELECT gene, CAST(count(*) AS VARCHAR) AS rows, CAST(count(DISTINCT tx) AS VARCHAR) AS transcripts FROM f WHERE gene IS NOT NULL GROUP BY gene")
def matrix_files(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """A matrix with a header, written and read again."""
    counts = annotation(spark, folder).select(attr("gene_id").alias("gene"), attr("transcript_id").alias("tx")).where("gene IS NOT NULL").groupBy("gene").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("tx").alias("transcripts"))
    W.write_table(counts, path)
    return R.read_matrix(spark, path)


@query("src_12_positions", "SELECT row_number() OVER (ORDER BY rid) - 1 AS position, feature AS value FROM f")
def position_files(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Values by position, written and read again."""
    from locusframe.model import with_position

    W.write_table(with_position(annotation(spark, folder)).select("position", F.col("feature").alias("value")), path, header=False)
    return R.read_positions(spark, path)


@query("src_16_terms", "SELECT rid FROM f WHERE gene IN (SELECT regexp_replace(lower(trim(gene_id)), '\\.[0-9]+$', '') FROM gene_ref WHERE gene_biotype = 'lncRNA')")
def term_files(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Genes per term, written and read again, and the rows of one term's genes."""
    from locusframe.functions.labels import identifier

    W.write_table(table(spark, folder, "gene_ref").select("gene_biotype", identifier(F.col("gene_id")).alias("gene_id")), path, header=False)
    return S.select_by_term(annotation(spark, folder), R.read_terms(spark, path), "lncRNA").select("rid")


@query("snk_06_table", "SELECT CAST(rid AS VARCHAR) AS rid, seqid, feature, coalesce(gene, '?') AS gene_id FROM f")
def table_files(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """An extraction as delimited text, written and read again."""
    W.write_table(extract(annotation(spark, folder), ["seqid", "feature", "gene_id"]), path)
    return R.read_matrix(spark, path)


@query("fun_01_text", "SELECT seqid, regexp_replace(seqid, '[^A-Za-z0-9]+', '.', 'g') AS clean, count(*) AS n FROM f GROUP BY seqid")
def texts(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Names in letters and digits only."""
    return annotation(spark, folder).groupBy("seqid").agg(F.count(F.lit(1)).alias("n")).select("seqid", T.alphanumeric(F.col("seqid"), ".").alias("clean"), "n")


@query("set_04_without", "SELECT rid FROM f WHERE tx IS NULL OR tx NOT IN (SELECT tx FROM f WHERE feature = 'cds' AND tx IS NOT NULL)")
def without(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Rows of transcripts without coding part."""
    rows = annotation(spark, folder).withColumn("tx", attr("transcript_id"))
    return S.without_keys(rows, rows.where("feature = 'cds'"), "tx").select("rid")
