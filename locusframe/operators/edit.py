"""Editing of attributes and columns, and key joins that add attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.model import ALIASES, FIXED, attr, attrs_of, value, with_attr, with_position
from locusframe.registry import operator

#: Attributes that are only deleted when forced.
PROTECTED = ("gene_id", "transcript_id")


def _chosen(features: str) -> Column:
    return F.lit(True) if features == "*" else F.col("feature").isin(features.split(","))


@operator("ATT-01", group="edit")
def add_prefix(rows: DataFrame, key: str, text: str, suffix: bool = False, features: str = "*") -> DataFrame:
    """Put text before (or after) a fixed column or an attribute of the chosen features."""

    def joined(v: Column) -> Column:
        return F.concat(v, F.lit(text)) if suffix else F.concat(F.lit(text), v)

    name = ALIASES.get(key, key)
    if name in FIXED:
        return rows.withColumn(name, F.when(_chosen(features), joined(F.col(name).cast("string"))).otherwise(F.col(name).cast("string")))
    changed = F.transform("attrs", lambda a: F.struct(a["key"].alias("key"), F.when(a["key"] == key, joined(a["value"])).otherwise(a["value"]).alias("value")))
    return rows.withColumn("attrs", F.when(_chosen(features), changed).otherwise(F.col("attrs")))


@operator("ATT-02", group="edit")
def delete_attributes(rows: DataFrame, keys: list[str] | str, regexp: bool = False, invert: bool = False, force: bool = False, features: str = "*") -> DataFrame:
    """Remove attributes by exact key, or by a pattern found in the key; invert removes all others. Ids need force."""

    def goes(key: Column) -> Column:
        hit = key.rlike(keys if isinstance(keys, str) else "|".join(keys)) if regexp else key.isin(keys.split(",") if isinstance(keys, str) else keys)
        hit = ~hit if invert else hit
        return hit if force else hit & ~key.isin(*PROTECTED)

    return rows.withColumn("attrs", F.when(_chosen(features), F.filter("attrs", lambda a: ~goes(a["key"]))).otherwise(F.col("attrs")))


@operator("ATT-03", group="edit")
def merge_attributes(rows: DataFrame, keys: list[str], new_key: str, sep: str = "|", features: str = "*") -> DataFrame:
    """Join the values of keys ('.' where undefined) into one attribute; an attribute of that name is rewritten."""
    joined = F.concat_ws(sep, *(F.coalesce(attr(k), value(k), F.lit(".")) for k in keys))
    return rows.withColumn("attrs", F.when(_chosen(features), with_attr(new_key, joined, overwrite=True)).otherwise(F.col("attrs")))


@operator("ATT-04", "ATT-06", "ATT-07", "SRC-10", group="edit")
def join_attribute(rows: DataFrame, pairs: DataFrame, key: str, new_key: str, features: str = "*", overwrite: bool = False, join_key: str = "key", join_value: str = "value", sep: str = "|") -> DataFrame:
    """Left join of (key, value) pairs: matched rows get the attribute; several values of a key are joined, in order of value.

    An existing attribute of that name stays first unless overwrite. Null keys match nothing. The pairs are one row
    per key after grouping; Spark broadcasts them if they are known to be small.
    """
    listed = pairs.select(F.col(f"`{join_key}`").cast("string").alias("__k"), F.col(f"`{join_value}`").cast("string").alias("__v")).where("__k IS NOT NULL AND __v IS NOT NULL")
    one = listed.groupBy("__k").agg(F.array_join(F.array_sort(F.collect_list("__v")), sep).alias("__v"))
    keyed = rows.withColumn("__k", F.when(_chosen(features), value(key)))
    return keyed.join(one, "__k", "left").withColumn("attrs", with_attr(new_key, F.col("__v"), overwrite)).drop("__k", "__v")


@operator("ATT-05", "SRC-11", group="edit")
def join_matrix(rows: DataFrame, matrix: DataFrame, key: str, matrix_key: str, features: str = "*") -> DataFrame:
    """Left join of a matrix: one new attribute per further column. Repeated keys keep the first row by all its columns."""
    names = [c for c in matrix.columns if c != matrix_key]
    wide = matrix.select(F.col(f"`{matrix_key}`").cast("string").alias("__k"), F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in names)).alias("__m")).where("__k IS NOT NULL").groupBy("__k").agg(F.min("__m").alias("__m"))
    out = rows.withColumn("__k", F.when(_chosen(features), value(key))).join(wide, "__k", "left")
    return out.withColumn("attrs", F.concat("attrs", attrs_of(**{c: F.col("__m")[c] for c in names}))).drop("__k", "__m")


@operator("ATT-08", "ATT-09", "SRC-12", group="edit")
def join_by_position(rows: DataFrame, values: DataFrame, new_key: str, position: str = "position", column: str = "value") -> DataFrame:
    """Add an attribute to rows at 0-based positions in file order; '?' and missing positions add nothing."""
    given = values.select(F.col(f"`{position}`").cast("bigint").alias("__p"), F.col(f"`{column}`").cast("string").alias("__v"))
    numbered = with_position(rows, name="__p").join(given, "__p", "left")
    return numbered.withColumn("attrs", with_attr(new_key, F.when(F.col("__v") != "?", F.col("__v")))).drop("__p", "__v")


@operator("ATT-10", group="edit")
def discretize(rows: DataFrame, key: str, new_key: str, levels: int, labels: list[str] | None = None, percentiles: bool = False, log: bool = False, of_distinct: bool = False, precision: int = 2) -> DataFrame:
    """Cut a numeric key into right-closed classes of equal width, or at percentiles, and write the class as an attribute.

    The lowest break lies a thousandth of the greatest value below the least one. Classes are called `[a_b]` unless
    labels are given. Rows without a number are left as they are. Fewer than two levels, equal values and tied
    breaks are errors. The breaks (levels + 1 numbers) are computed over all rows and read to the driver.
    """
    if levels < 2:
        raise ValueError("at least two levels are needed")
    x = value(key).try_cast("double")
    x = F.log2(x) if log else x
    seen = rows.select(x.alias("x")).where("x IS NOT NULL")
    if percentiles:
        seen = seen.distinct() if of_distinct else seen
        marks = [i / levels for i in range(levels + 1)]
        breaks = seen.agg(F.percentile("x", F.array(*[F.lit(m) for m in marks])).alias("b")).first()["b"]
    else:
        low, high = seen.agg(F.min("x"), F.max("x")).first()
        breaks = None if low is None else [low + (high - low) * i / levels for i in range(levels + 1)]
    if not breaks or len(set(breaks)) <= levels:
        raise ValueError("the values can't be cut: no numbers, all equal, or tied breaks")
    names = labels or [f"[{round(a, precision)}_{round(b, precision)}]" for a, b in zip(breaks, breaks[1:], strict=False)]
    chain = F.when(x <= breaks[1], names[0])
    for b, n in zip(breaks[2:-1], names[1:-1], strict=True):
        chain = chain.when(x <= b, n)
    chain = chain.when(x.isNotNull(), names[-1])
    return rows.withColumn("attrs", with_attr(new_key, chain, overwrite=True))


@operator("ATT-11", group="edit")
def to_ensembl(rows: DataFrame) -> DataFrame:
    """Add transcript and gene rows that are missing: they span their members.

    A new transcript copies the attributes of its first row except those whose key starts with `exon`; a new gene those
    whose key starts with `gene`, holds `_gene_` or ends with `_gene`. New rows stand just before the first member:
    `rid` becomes DOUBLE. A gene on several sequences is an error.
    """
    keyed = rows.withColumns({"rid": F.col("rid").cast("double"), "__tx": attr("transcript_id"), "__gene": attr("gene_id")})

    def kept_key(feature: str, k: Column) -> Column:
        return ~k.startswith("exon") if feature == "transcript" else k.startswith("gene") | k.contains("_gene_") | k.endswith("_gene")

    def spanned(members: DataFrame, key: str, feature: str, shift: float, source: str) -> DataFrame:
        first = F.min_by(F.struct("source", "seqid", "strand", "attrs"), "rid").alias("f")
        own = F.max((F.col("feature") == feature).cast("int")).alias("own")
        places = (F.min("seqid") != F.max("seqid")).alias("spread")
        spans = members.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("rid").alias("rid"), first, own, places).where("own = 0")
        seqid = F.when(F.col("spread"), F.raise_error(F.concat(F.lit(f"on several sequences: {key} "), F.col(key))).cast("string")).otherwise(F.col("f.seqid"))
        kept = F.filter(F.col("f.attrs"), lambda a: kept_key(feature, a["key"]))
        named = F.coalesce(F.get(F.filter(F.col("f.attrs"), lambda a: a["key"] == source), 0)["value"], F.col("f.source"))
        return spans.select((F.col("rid") - shift).alias("rid"), seqid.alias("seqid"), named.alias("source"), F.lit(feature).alias("feature"), "start", "end", F.lit(".").alias("score"), F.col("f.strand").alias("strand"), F.lit(".").alias("phase"), kept.alias("attrs"))

    out = ["rid", *FIXED, "attrs"]
    transcripts = spanned(keyed, "__tx", "transcript", 0.25, "transcript_source")
    genes = spanned(keyed, "__gene", "gene", 0.5, "gene_source")
    return keyed.select(*out).unionByName(transcripts.select(*out)).unionByName(genes.select(*out))


@operator("ATT-12", group="edit")
def bed_to_annotation(bed: DataFrame, feature: str = "transcript", source: str = "Unknown") -> DataFrame:
    """0-based half-open intervals as annotation rows: the name is the id of gene and transcript (and exon), start is moved by 1."""
    name = F.coalesce("name", F.concat(F.lit("feature_"), F.col("rid").cast("string")))
    ids = {"gene_id": name, "transcript_id": F.when(F.lit(feature != "gene"), name), "exon_id": F.when(F.lit(feature == "exon"), name)}
    return bed.select("rid", F.col("chrom").alias("seqid"), F.lit(source).alias("source"), F.lit(feature).alias("feature"), (F.col("start") + 1).alias("start"), "end", F.coalesce("score", F.lit("0")).alias("score"), F.coalesce("strand", F.lit(".")).alias("strand"), F.lit(".").alias("phase"), attrs_of(**ids).alias("attrs"))


@operator("ATT-13", group="edit")
def prepared(rows: DataFrame, keep: list[str], features: str = "*", add_missing: bool = False) -> DataFrame:
    """Rows of some features with some attributes only (the ids always stay), missing gene and transcript rows added if wanted."""
    chosen = rows.where(_chosen(features)).withColumn("attrs", F.filter("attrs", lambda a: a["key"].isin(*keep, *PROTECTED)))
    return to_ensembl(chosen) if add_missing else chosen
