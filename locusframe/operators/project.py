"""Projection of annotation rows to tables, lists, maps and catalogues."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from locusframe.model import FIXED, UNDEFINED, UNSET, attr, value
from locusframe.operators.blocks import ranked_places
from locusframe.registry import operator


@operator("PRJ-04", group="project")
def attribute_names(rows: DataFrame) -> DataFrame:
    """Attribute keys with the rid and place of their first use (order by these for first-seen order)."""
    each = rows.select("rid", F.posexplode("attrs").alias("pos", "a"))
    return each.groupBy(F.col("a.key").alias("key")).agg(F.min(F.struct("rid", "pos")).alias("f")).select("key", F.col("f.rid").alias("first_rid"), F.col("f.pos").alias("first_pos"))


@operator("PRJ-01", "PRJ-09", "SEL-23", "SET-01", group="project")
def extract(rows: DataFrame, keys: list[str], zero_based: bool = False, distinct: bool = False, no_unset: bool = False, no_undefined: bool = False) -> DataFrame:
    """The keys as text columns, '?' where a row lacks one, with rid; the key `all` stands for every column and attribute.

    distinct keeps the first of equal rows; no_unset drops rows with a '.', no_undefined those with a '?'.
    """
    if keys == ["all"]:
        keys = [*FIXED, *(r["key"] for r in attribute_names(rows).orderBy("first_rid", "first_pos").collect())]
    columns = [F.coalesce((F.col("start") - 1).cast("string") if zero_based and k == "start" else value(k), F.lit(UNDEFINED)).alias(k) for k in keys]
    out = rows.select("rid", *columns)
    for marker, drop in ((UNSET, no_unset), (UNDEFINED, no_undefined)):
        if drop:
            for k in keys:
                out = out.where(F.col(f"`{k}`") != marker)
    return out.groupBy(*(f"`{k}`" for k in keys)).agg(F.min("rid").alias("rid")).select("rid", *(f"`{k}`" for k in keys)) if distinct else out


def _pairs(rows: DataFrame, key: str, item: str) -> DataFrame:
    return rows.select("rid", value(key).alias("key"), value(item).alias("value")).where("key IS NOT NULL AND value IS NOT NULL AND key NOT IN ('.', '?')")


@operator("PRJ-02", group="project")
def first_values(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, value): the first value met per key."""
    return _pairs(rows, key, item).groupBy("key").agg(F.min_by("value", "rid").alias("value"))


def last_values(rows: DataFrame, key: str, items: list[str]) -> DataFrame:
    """(key, items): the values of the last row per key; '?' where it lacks one."""
    fields = [F.coalesce(value(i), F.lit(UNDEFINED)).alias(i) for i in items]
    keyed = rows.select("rid", value(key).alias("key"), *fields).where("key IS NOT NULL")
    return keyed.groupBy("key").agg(F.max_by(F.struct(*items), "rid").alias("x")).select("key", "x.*")


def merged_values(rows: DataFrame, key: str, item: str, distinct: bool = True) -> DataFrame:
    """(key, values): all values per key in file order as an array; repeated ones once if distinct."""
    gathered = _pairs(rows, key, item)
    if distinct:
        gathered = gathered.groupBy("key", "value").agg(F.min("rid").alias("rid"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rid", "value"))), lambda x: x["value"])
    return gathered.groupBy("key").agg(ordered.alias("values"))


@operator("PRJ-03", group="project")
def iterate(rows: DataFrame, keys: list[str]) -> Iterator[Row]:
    """Rows of an extraction in file order, fetched partition by partition."""
    return extract(rows, keys).orderBy("rid").toLocalIterator()


@operator("PRJ-05", group="project")
def attribute_values(rows: DataFrame, key: str) -> DataFrame:
    """(value, n): distinct values of a key with the number of rows that have them."""
    return rows.select(value(key).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@operator("PRJ-06", group="project")
def distinct_keys(rows: DataFrame, key: str) -> DataFrame:
    """(value, first_rid): distinct values of a column or attribute with where they were met first."""
    return rows.select("rid", value(key).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.min("rid").alias("first_rid"))


@operator("PRJ-07", group="project")
def gene_of_transcript(rows: DataFrame) -> DataFrame:
    """(key, value): gene of every transcript."""
    return first_values(rows, "transcript_id", "gene_id")


def strand_of(rows: DataFrame, feature: str = "gene") -> DataFrame:
    """(key, value): strand of every gene or transcript, from its own row."""
    return first_values(rows.where(F.col("feature") == feature), f"{feature}_id", "strand")


@operator("PRJ-08", group="project")
def transcripts_by_tss(rows: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, tss, tss_rank): transcripts of each gene with the dense rank of their start site, 5' to 3'.

    Distinct sites are ranked in blocks of positions, so a gene of any number of transcripts never meets in one task.
    """
    tss = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    tx = rows.where(F.col("feature") == "transcript").select(attr("gene_id").alias("gene_id"), attr("transcript_id").alias("transcript_id"), tss.alias("tss"), (tss * sign).alias("way")).where("gene_id IS NOT NULL AND transcript_id IS NOT NULL").distinct()
    sites = ranked_places(tx.select("gene_id", "way").distinct(), ["gene_id"], "way")
    return tx.join(sites.withColumnRenamed("rank", "tss_rank"), ["gene_id", "way"]).drop("way")


@operator("PRJ-10", group="project")
def columns_of(table: DataFrame, columns: list[str], invert: bool = False, distinct: bool = False, more: dict[str, str] | None = None) -> DataFrame:
    """Some columns of any table (invert: all but these), distinct rows if wanted, and constant columns."""
    out = table.drop(*columns) if invert else table.select(*(f"`{c}`" for c in columns))
    out = out.distinct() if distinct else out
    return out.withColumns({k: F.lit(v) for k, v in (more or {}).items()})


@operator("PRJ-11", "PRJ-12", group="project")
def attribute(key: str, upon_none: str = "continue") -> Column:
    """The key as a column: null (`continue`), '.' (`set_na`) or an error (`raise`) where a row lacks it."""
    v = value(key)
    if upon_none == "set_na":
        return F.coalesce(v, F.lit(UNSET))
    return F.coalesce(v, F.raise_error(F.lit(f"undefined: {key}")).cast("string")) if upon_none == "raise" else v


@operator("TYPES", group="project")
def inferred_types(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, type): narrowest of boolean, integer, float, char, string that holds all values; '.' and '?' and '' don't count.

    A key of 0, 1 and other digits is an integer. Keys without values are `unset`.
    """
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), value(k).alias("v")) for k in keys])).alias("x")).select("x.*")
    level = F.when(F.col("v").isNull() | F.col("v").isin("", ".", "?"), None).when(F.col("v").isin("0", "1"), 1).when(F.col("v").rlike(r"\A[0-9]+\z"), 2).when(F.col("v").try_cast("double").isNotNull(), 3).when(F.length("v") == 1, 4).otherwise(5)
    numeric, text = F.max(F.when(level <= 3, level)), F.max(F.when(level > 3, level))
    names = F.array(*[F.lit(n) for n in ("boolean", "integer", "float", "char", "string")])
    top = F.when(text.isNotNull() & numeric.isNotNull(), 5).otherwise(F.coalesce(text, numeric))
    return each.groupBy("key").agg(F.coalesce(F.get(names, top - 1), F.lit("unset")).alias("type"))
