"""The annotation table: eight fixed columns, a file-order key and an ordered multimap of attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions.labels import identifier, label, refers, valid_span
from locusframe.session import table

ATTRS = "array<struct<key:string,value:string>>"
#: The columns of an annotation row and other names under which they may be asked for.
FIXED = ("seqid", "source", "feature", "start", "end", "score", "strand", "phase")
ALIASES = {"chrom": "seqid", "chr": "seqid", "seqname": "seqid", "seq_id": "seqid", "seq_name": "seqid", "frame": "phase", "ft_type": "feature", "src": "source"}
UNSET, UNDEFINED = ".", "?"


def attr(key: str, attrs: str = "attrs") -> Column:
    """Value of the first attribute with this key; null if the row doesn't have it."""
    return F.get(F.filter(attrs, lambda a: a["key"] == key), 0)["value"]


def value(key: str) -> Column:
    """A fixed column (also under another usual name) or an attribute, as text; null where the key is undefined."""
    name = ALIASES.get(key, key)
    return F.col(name).cast("string") if name in FIXED else attr(key)


def attrs_of(**columns: Column) -> Column:
    """Attribute array of the given values in order; nulls are left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()])
    return F.filter(entries, lambda a: a["value"].isNotNull())


def with_attr(key: str, new: Column, overwrite: bool = False) -> Column:
    """Attributes with an entry appended (nothing is appended for null); `overwrite` drops entries of that key first."""
    kept = F.filter("attrs", lambda a: a["key"] != key) if overwrite else F.col("attrs")
    return F.when(new.isNotNull(), F.concat(kept, F.array(F.struct(F.lit(key).alias("key"), new.cast("string").alias("value"))))).otherwise(F.col("attrs"))


def with_position(rows: DataFrame, order: str = "rid", name: str = "position", block: int = 1 << 20) -> DataFrame:
    """Consecutive 0-based position in the order of a unique LONG column, without gathering the table in one task.

    Rows are numbered inside blocks of the order column; the blocks' row counts (one row per block) are summed up.
    """
    cut = rows.withColumn("__block", F.floor(F.col(order) / block).cast("bigint"))
    sizes = cut.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    numbered = cut.withColumn("__row", F.row_number().over(Window.partitionBy("__block").orderBy(order)))
    return numbered.join(offsets, "__block").withColumn(name, F.col("__offset") + F.col("__row") - 1).drop("__block", "__row", "__offset")


def annotation(spark: SparkSession, folder: str, attributes: bool = False) -> DataFrame:
    """The `features` table as an annotation table: sound rows of any strand, labels and ids in their returned form.

    With `attributes`, rows get the entries of `gtf_attribute` (in order of pos, without rows written twice) appended.
    """
    raw = table(spark, folder, "features")
    rows = raw.where(refers(F.col("seqid")) & refers(F.col("feature")) & valid_span(F.col("start_pos"), F.col("end_pos")))
    ids = {c: F.when(refers(F.col(c)), identifier(F.col(c))) for c in ("gene_id", "transcript_id")}
    base = rows.select("rid", label(F.col("seqid")).alias("seqid"), "source", label(F.col("feature")).alias("feature"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "score", "strand", "phase", attrs_of(**ids).alias("attrs"))
    if not attributes:
        return base
    long = table(spark, folder, "gtf_attribute").select("rid", "pos", label(F.col("attr_key")).alias("key"), F.btrim("attr_value").alias("value"))
    long = long.where(F.col("key").isNotNull() & F.col("value").isNotNull() & ~F.col("key").isin("gene_id", "transcript_id"))
    own = long.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("pos", "key", "value"))).alias("own"))
    more = F.transform(F.coalesce("own", F.array().cast("array<struct<pos:int,key:string,value:string>>")), lambda a: F.struct(a["key"].alias("key"), a["value"].alias("value")))
    return base.join(own, "rid", "left").withColumn("attrs", F.concat("attrs", more)).drop("own")


def bed(rows: DataFrame, name: list[str] | tuple[str, ...] = ("gene_id",), sep: str = "|", more: list[str] | tuple[str, ...] = (), missing: str = UNDEFINED, add_feature: bool = False) -> DataFrame:
    """Annotation rows as 0-based half-open intervals: chrom, start, end, name, score, strand (and rid)."""
    parts = [F.coalesce(value(n), F.lit(missing)) for n in name] + [F.lit(m) for m in more] + ([F.col("feature")] if add_feature else [])
    return rows.select("rid", F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("start"), "end", F.concat_ws(sep, *parts).alias("name"), "score", "strand")
