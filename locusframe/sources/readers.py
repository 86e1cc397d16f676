"""Readers of annotation, interval, track, sequence and key files. All are lazy and give explicit schemas."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.model import ATTRS
from locusframe.registry import operator

#: A record of an attribute list, key and value, quoted or bare.
ATTRIBUTE = r"([^\s;]+)\s+(?:\"([^\"]*)\"|([^\";\s]+))"


def parsed_attributes(text: Column) -> Column:
    """Attribute list as an ordered array of (key, value); repeated keys are kept, a value ends at its closing quote."""
    keys, quoted, bare = (F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(i)) for i in (1, 2, 3))
    zipped = F.zip_with(keys, F.zip_with(quoted, bare, lambda q, b: F.when(b != "", b).otherwise(q)), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return F.coalesce(zipped, F.array().cast(ATTRS))


@operator("SRC-01", "SRC-02", "SRC-03", group="sources")
def read_annotation(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Nine-column annotation text (also .gz) as an annotation table; rid follows the file order.

    Comments and blank lines are skipped. strict raises on a line without nine fields, otherwise it is left out
    (operators.quarantine gives the reason). Lines may be of any length. rid is unique and ordered, not consecutive.
    """
    lines = spark.read.text(path).withColumn("rid", F.monotonically_increasing_id())
    kept = lines.select("rid", F.btrim("value", F.lit(" \r\n")).alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    part = F.split("line", "\t", -1)
    nine = F.size(part) == 9
    if strict:
        part = F.when(nine, part).otherwise(F.raise_error(F.concat(F.lit("not nine columns: "), F.col("line"))).cast("array<string>"))
    else:
        kept = kept.where(nine)
    f = kept.select("rid", part.alias("f"))
    return f.select("rid", *(F.get("f", i).alias(n) for i, n in enumerate(("seqid", "source", "feature"))), F.get("f", 3).try_cast("bigint").alias("start"), F.get("f", 4).try_cast("bigint").alias("end"), *(F.get("f", i).alias(n) for i, n in ((5, "score"), (6, "strand"), (7, "phase"))), parsed_attributes(F.get("f", 8)).alias("attrs"))


@operator("SRC-04", group="sources")
def has_ensembl_rows(rows: DataFrame) -> bool:
    """True if any row is a gene or a transcript; reads until one is found."""
    return bool(rows.where(F.col("feature").isin("gene", "transcript")).limit(1).count())


@operator("SRC-05", group="sources")
def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals with 3 to 12 columns as rid, chrom, start, end, name, score, strand.

    Without a name they are `region_` and the rid, the score is 0 and the strand '.'. Comment, track and browser lines
    are skipped.
    """
    lines = spark.read.text(path).withColumn("rid", F.monotonically_increasing_id()).where(~F.col("value").rlike(r"\A\s*(?:#|track|browser|\z)"))
    f = lines.select("rid", F.split("value", "\t", -1).alias("f"))
    name = F.coalesce(F.get("f", 3), F.concat(F.lit("region_"), F.col("rid").cast("string")))
    return f.select("rid", F.get("f", 0).alias("chrom"), F.get("f", 1).try_cast("bigint").alias("start"), F.get("f", 2).try_cast("bigint").alias("end"), name.alias("name"), F.coalesce(F.get("f", 4), F.lit("0")).alias("score"), F.coalesce(F.get("f", 5), F.lit(".")).alias("strand"))


@operator("SRC-06", group="sources")
def read_sizes(spark: SparkSession, path: str, drop_odd: bool = False) -> DataFrame:
    """(chrom, size): comments, blank lines and a header are skipped; drop_odd leaves out unplaced and mitochondrial ones."""
    f = spark.read.text(path).select(F.split(F.btrim("value"), r"\s+").alias("f"))
    out = f.where(~F.get("f", 0).rlike(r"\A(?:#|\z|chrom\z)")).select(F.get("f", 0).alias("chrom"), F.get("f", 1).try_cast("bigint").alias("size")).where("size IS NOT NULL")
    return out.where(~F.col("chrom").rlike("random|Un|hap|alt|^chrM$")) if drop_odd else out


@operator("SRC-08", group="sources")
def read_track(spark: SparkSession, path: str, track: str) -> DataFrame:
    """Four-column track text as (track, chrom, start, end, value)."""
    f = spark.read.text(path).where(~F.col("value").rlike(r"\A\s*(?:#|track|browser|\z)")).select(F.split("value", r"\s+").alias("f"))
    return f.select(F.lit(track).alias("track"), F.get("f", 0).alias("chrom"), F.get("f", 1).try_cast("bigint").alias("start"), F.get("f", 2).try_cast("bigint").alias("end"), F.get("f", 3).try_cast("double").alias("value"))


@operator("SRC-09", group="sources")
def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, sequence): records split at `>`; the name ends at the first blank. A record is read by one task."""
    records = spark.read.text(path, lineSep=">").where(F.btrim("value") != "")
    head = F.regexp_extract("value", r"\A([^\s]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"\A[^\n]*", ""), r"\s", "")
    return records.select(head.alias("chrom"), body.alias("sequence"))


@operator("SRC-10", group="sources")
def read_pairs(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(key, value) of a two-column file; operators.edit.join_attribute joins repeated keys."""
    rows = spark.read.option("sep", "\t").option("header", header).option("quote", "").csv(path)
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("key"), F.col(f"`{rows.columns[1]}`").alias("value"))


@operator("SRC-11", group="sources")
def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A matrix with a header of keys; ragged rows raise."""
    names = spark.read.text(path).limit(1).first()["value"].split("\t")
    schema = ", ".join(f"`{n}` STRING" for n in names)
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "FAILFAST").option("quote", "").csv(path)


@operator("SRC-12", group="sources")
def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(position, value) of a `pos<TAB>value` file, or of a one-column file in the order of its lines."""
    lines = spark.read.text(path).withColumn("rid", F.monotonically_increasing_id())
    f = lines.select("rid", F.split("value", "\t", -1).alias("f"))
    given = f.where(F.size("f") > 1).select(F.get("f", 0).try_cast("bigint").alias("position"), F.get("f", 1).alias("value"))
    from locusframe.model import with_position

    plain = with_position(f.where(F.size("f") == 1).select("rid", F.get("f", 0).alias("value"))).select("position", "value")
    return given.unionByName(plain)


@operator("SRC-13", group="sources")
def read_sqlite(spark: SparkSession, path: str, name: str, most: int = 1_000_000) -> DataFrame:
    """All rows of one table of an SQLite file, as text. Read on the driver; more than `most` rows raise."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"no table name: {name}")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        cursor = db.execute(f"SELECT * FROM {name} LIMIT {most + 1}")
        rows = [tuple(None if v is None else str(v) for v in r) for r in cursor]
        columns = [d[0] for d in cursor.description]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: export the table to files and read those")
    return spark.createDataFrame(rows, ", ".join(f"`{c}` STRING" for c in columns))


def sqlite_tables(path: str) -> list[str]:
    """Names of the tables of an SQLite file."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return sorted(r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'"))


@operator("SRC-14", group="sources")
def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular alignment hits (12 columns) as annotation rows of feature HSP: the subject is the sequence, the rest attributes."""
    names = ("query", "subject", "identity", "length", "mismatches", "gaps", "query_start", "query_end", "subject_start", "subject_end", "evalue", "bit_score")
    lines = spark.read.text(path).withColumn("rid", F.monotonically_increasing_id()).where(~F.col("value").rlike(r"\A\s*(?:#|\z)"))
    f = lines.select("rid", F.split("value", "\t", -1).alias("f")).where(F.size("f") >= 12)
    col = {n: F.get("f", i) for i, n in enumerate(names)}
    s, e = col["subject_start"].try_cast("bigint"), col["subject_end"].try_cast("bigint")
    kept = [n for n in names if n not in ("subject", "subject_start", "subject_end", "bit_score")]
    attrs = F.array(*[F.struct(F.lit(n).alias("key"), col[n].alias("value")) for n in kept])
    return f.select("rid", col["subject"].alias("seqid"), F.lit("alignment").alias("source"), F.lit("HSP").alias("feature"), F.least(s, e).alias("start"), F.greatest(s, e).alias("end"), col["bit_score"].alias("score"), F.when(s <= e, "+").otherwise("-").alias("strand"), F.lit(".").alias("phase"), attrs.alias("attrs"))


@operator("SRC-15", group="sources")
def chosen_release_file(names: list[str]) -> str | None:
    """The annotation file to take of a release folder: one of chromosomes first, then one that isn't ab initio."""
    sound = sorted(n for n in names if n.endswith(".gtf.gz"))
    for test in (lambda n: n.endswith(".chr.gtf.gz"), lambda n: "abinitio" not in n, lambda n: True):
        if found := [n for n in sound if test(n)]:
            return found[0]
    return None


@operator("SRC-18", group="sources")
def read_signal_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A binned matrix whose first line is `#key:value;...`, and that line as a map."""
    first = spark.read.text(path).limit(1).first()["value"]
    config = dict(x.split(":", 1) for x in first.lstrip("#").split(";") if ":" in x)
    return spark.read.option("sep", "\t").option("header", True).option("comment", "#").option("quote", "").csv(path), config


@operator("SRC-16", group="sources")
def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, gene_id) of a two-column table of terms and their genes, in place of a query of a remote registry."""
    return read_pairs(spark, path).select(F.col("key").alias("term"), F.col("value").alias("gene_id")).where("term IS NOT NULL AND gene_id IS NOT NULL").distinct()


@operator("SRC-17", group="sources")
def example(spark: SparkSession, genes: int = 10, exons: int = 3) -> DataFrame:
    """A small made-up annotation table: so many genes in a row, on alternating strands, of one transcript each."""
    at = F.col("id") * 1000 + 101
    gene, tx = F.format_string("G%04d", F.col("id") + 1), F.format_string("G%04dT001", F.col("id") + 1)
    own = [("gene", at, at + 100 * exons - 1, False), ("transcript", at, at + 100 * exons - 1, True), *(("exon", at + 100 * i, at + 100 * i + 49, True) for i in range(exons))]
    each = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(f).alias("feature"), s.alias("start"), e.alias("end"), F.when(F.lit(t), tx).alias("tx")) for n, (f, s, e, t) in enumerate(own)))
    rows = spark.range(genes).select("id", gene.alias("gene"), F.explode(each).alias("x"))
    ids = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("gene_id", F.col("gene")), ("transcript_id", F.col("x.tx"))))), lambda a: a["value"].isNotNull())
    return rows.select((F.col("id") * len(own) + F.col("x.n")).alias("rid"), F.lit("chr1").alias("seqid"), F.lit("made").alias("source"), "x.feature", "x.start", "x.end", F.lit(".").alias("score"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(".").alias("phase"), ids.alias("attrs"))


def ordered(rows: DataFrame) -> DataFrame:
    """rid made consecutive from 0 in its own order."""
    from locusframe.model import with_position

    return with_position(rows).drop("rid").withColumnRenamed("position", "rid")
