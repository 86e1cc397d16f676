"""Counts, sizes and numberings per feature, transcript and gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.model import attr, value, with_attr
from locusframe.operators.blocks import summed_before
from locusframe.operators.skew import hot_keys, replicated, salted
from locusframe.registry import operator
from locusframe.session import cut

#: Parts that the transcripts of a hot gene are cut into before each part meets all of them.
SALTS = 64


def _tss() -> Column:
    return F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))


def _exons(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("feature") == "exon").withColumn("transcript_id", attr("transcript_id")).where("transcript_id IS NOT NULL")


@operator("AGG-01", group="aggregate")
def count_features(rows: DataFrame) -> DataFrame:
    """(feature, n, first_rid): rows per feature; order by first_rid for first-seen order."""
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first_rid"))


@operator("AGG-02", group="aggregate")
def count_key_values(rows: DataFrame, keys: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """(key, n): values (or distinct values) per key; of all attributes if no keys are given."""
    if keys is None:
        each = rows.select(F.explode("attrs").alias("x")).select("x.*")
    else:
        each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), value(k).alias("value")) for k in keys])).alias("x")).select("x.*")
    counted = F.count_distinct("value") if distinct else F.count("value")
    return each.groupBy("key").agg(counted.alias("n"))


@operator("AGG-03", group="aggregate")
def exon_counts(rows: DataFrame) -> DataFrame:
    """(transcript_id, nb_exons): exon rows per transcript, 0 if it has none."""
    keyed = rows.withColumn("transcript_id", attr("transcript_id")).where("transcript_id IS NOT NULL")
    return keyed.groupBy("transcript_id").agg(F.count(F.when(F.col("feature") == "exon", 1)).alias("nb_exons"))


@operator("AGG-04", group="aggregate")
def transcript_counts(rows: DataFrame) -> DataFrame:
    """(gene_id, nb_tx): distinct transcripts per gene."""
    return rows.select(attr("gene_id").alias("gene_id"), attr("transcript_id").alias("t")).where("gene_id IS NOT NULL").groupBy("gene_id").agg(F.count_distinct("t").alias("nb_tx"))


@operator("AGG-05", group="aggregate")
def transcript_sizes(rows: DataFrame, with_introns: bool = False) -> DataFrame:
    """(transcript_id, size): summed exon length, or the span from the first to the last exon base."""
    size = F.max("end") - F.min("start") + 1 if with_introns else F.sum(F.col("end") - F.col("start") + 1)
    return _exons(rows).groupBy("transcript_id").agg(size.cast("bigint").alias("size"))


@operator("AGG-06", group="aggregate")
def feature_sizes(rows: DataFrame, feature: str = "*", without_last: bool = False) -> DataFrame:
    """(rid, size): length of every row of a feature; without_last gives end - start, as the size of a stored span."""
    chosen = rows if feature == "*" else rows.where(F.col("feature") == feature)
    return chosen.select("rid", (F.col("end") - F.col("start") + (0 if without_last else 1)).alias("size"))


def exon_size_lists(rows: DataFrame) -> DataFrame:
    """(transcript_id, exon_sizes): exon lengths in file order, joined by commas."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rid", (F.col("end") - F.col("start") + 1).alias("n")))), lambda x: x["n"].cast("string"))
    return _exons(rows).groupBy("transcript_id").agg(F.array_join(ordered, ",").alias("exon_sizes"))


def intron_size_lists(rows: DataFrame) -> DataFrame:
    """(transcript_id, intron_sizes): intron lengths from 5' to 3', joined by commas; '0' for one exon.

    An exon that is there twice counts once, whatever its strands.
    """
    exons = _exons(rows).groupBy("transcript_id", "start", "end").agg(F.min("strand").alias("strand"))
    gaps = exons.withColumn("gap", F.lead("start").over(Window.partitionBy("transcript_id").orderBy("start", "end")) - F.col("end") - 1)
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("start", "end", "gap")))), lambda x: x["gap"].cast("string"))
    lists = gaps.groupBy("transcript_id").agg(ordered.alias("l"), F.min("strand").alias("strand"))
    way = F.when(F.col("strand") == "-", F.reverse("l")).otherwise(F.col("l"))
    return lists.select("transcript_id", F.when(F.size("l") == 0, "0").otherwise(F.array_join(way, ",")).alias("intron_sizes"))


@operator("AGG-07", group="aggregate")
def tss_ladder(rows: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, tss, tss_rank, dist, from_first, n_further): every transcript with its start site's place in the gene.

    `dist` is the distance to the gene's site before (null for the first rank), `from_first` that to its first site and
    `n_further` the number of the gene's transcripts of higher rank: the links in which it comes first. Any two transcripts of a
    gene are as far apart as their `tss` differ, so this holds all pairs in one row per transcript, whatever the size
    of the gene; tss_distances writes out the pairs of asked transcripts.
    """
    from locusframe.operators.project import transcripts_by_tss

    ranked = cut(transcripts_by_tss(rows))
    sites = ranked.groupBy("gene_id", "tss_rank").agg(F.min("tss").alias("site"), F.count(F.lit(1)).alias("n"))
    before = sites.select("gene_id", (F.col("tss_rank") + 1).alias("tss_rank"), F.col("site").alias("last"))
    genes = ranked.groupBy("gene_id").agg(F.min(F.struct("tss_rank", "tss"))["tss"].alias("first"), F.count(F.lit(1)).alias("all"))
    upto = summed_before(sites, ["gene_id"], "tss_rank", "fewer", F.col("n")).select("gene_id", "tss_rank", (F.col("fewer") + F.col("n")).alias("upto"))
    out = ranked.join(before, ["gene_id", "tss_rank"], "left").join(upto, ["gene_id", "tss_rank"]).join(genes, "gene_id")
    return out.select("gene_id", "transcript_id", "tss", "tss_rank", F.abs(F.col("tss") - F.col("last")).alias("dist"), F.abs(F.col("tss") - F.col("first")).alias("from_first"), (F.col("all") - F.col("upto")).alias("n_further"))


def tss_distances(rows: DataFrame, asked: Column | None = None) -> DataFrame:
    """(gene_id, tx_1, tx_2, dist, rank_1, rank_2): pairs of transcripts of a gene, the one of lower TSS rank first.

    asked: a condition on transcript rows; only pairs with at least one such transcript come out, each once. Without it
    all pairs do: work and output then grow with the square of a gene's transcripts. Those of a hot gene are salted: each
    part of the asked transcripts meets all of the gene in a task of its own. The number of tasks is fixed, as by their
    input these would be put together again.
    """
    from locusframe.operators.project import transcripts_by_tss

    chosen = rows.where(F.col("feature") == "transcript")
    picked = (chosen if asked is None else chosen.where(asked)).select(attr("gene_id").alias("gene_id"), attr("transcript_id").alias("transcript_id")).distinct().withColumn("asked", F.lit(True))
    ranked = cut(transcripts_by_tss(rows).join(picked, ["gene_id", "transcript_id"], "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
    counts = ranked.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))
    hot = cut(hot_keys(counts, ["gene_id"], ranked.count()))
    left = salted(ranked.where("asked"), hot, ["gene_id"], "transcript_id", SALTS).repartition(SALTS, "gene_id", "salt")
    right = replicated(ranked, hot, ["gene_id"], SALTS).repartition(SALTS, "gene_id", "salt")
    a, b = (side.select("gene_id", "salt", *(F.col(c).alias(f"{c}_{i}") for c in ("transcript_id", "tss", "tss_rank", "asked"))) for i, side in ((1, left), (2, right)))
    lower = F.struct("tss_rank_1", "transcript_id_1", "tss_1") < F.struct(F.col("tss_rank_2").alias("tss_rank_1"), F.col("transcript_id_2").alias("transcript_id_1"), F.col("tss_2").alias("tss_1"))
    # A pair of two asked transcripts is met from both sides and kept from the lower one.
    met = a.join(b, ["gene_id", "salt"]).where((F.col("transcript_id_1") != F.col("transcript_id_2")) | (F.col("tss_1") != F.col("tss_2"))).where(lower | ~F.col("asked_2"))
    first, second = (lambda c, i=i: F.when(lower, F.col(f"{c}_{i}")).otherwise(F.col(f"{c}_{3 - i}")) for i in (1, 2))
    return met.select("gene_id", first("transcript_id").alias("tx_1"), second("transcript_id").alias("tx_2"), F.abs(F.col("tss_1") - F.col("tss_2")).alias("dist"), first("tss_rank").alias("rank_1"), second("tss_rank").alias("rank_2"))


@operator("AGG-08", group="aggregate")
def profile_statistics(rows: DataFrame, keys: list[str], measure: str = "value") -> DataFrame:
    """Per group: n, mean, median, mad (mean absolute deviation), std, min, max, sum and half-widths of 95 % intervals."""
    means = rows.groupBy(*keys).agg(F.avg(measure).alias("mean"), F.percentile(measure, F.lit(0.5)).alias("median"), F.stddev_samp(measure).alias("std"), F.min(measure).alias("min"), F.max(measure).alias("max"), F.sum(measure).alias("sum"), F.count(measure).alias("n"))
    around = rows.join(means.select(*keys, "mean"), keys).groupBy(*keys).agg(F.avg(F.abs(F.col(measure) - F.col("mean"))).alias("mad"))
    root = F.sqrt("n")
    return means.join(around, keys).withColumns({"ci_mean": 1.96 * F.col("std") / root, "ci_median": 1.96 * F.col("mad") / root})


@operator("AGG-09", group="aggregate")
def moments(rows: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Per group: n, mean, population variance, skewness and excess kurtosis."""
    return rows.groupBy(*keys).agg(F.count(measure).alias("n"), F.avg(measure).alias("mean"), F.var_pop(measure).alias("var"), F.skewness(measure).alias("skew"), F.kurtosis(measure).alias("kurt"))


@operator("AGG-10", group="aggregate")
def merged_moments(parts: DataFrame, keys: list[str], n: str = "n", mean: str = "mean", var: str = "var") -> DataFrame:
    """Per group: n, mean and population variance of all parts together, from those of the parts."""
    m = F.sum(F.col(n) * F.col(mean)) / F.sum(n)
    squares = F.sum(F.col(n) * (F.col(var) + F.col(mean) * F.col(mean))) / F.sum(n)
    return parts.groupBy(*keys).agg(F.sum(n).alias("n"), m.alias("mean"), squares.alias("__sq")).withColumn("var", F.col("__sq") - F.col("mean") * F.col("mean")).drop("__sq")


@operator("WIN-01", group="window")
def add_exon_number(rows: DataFrame, key: str = "exon_nbr") -> DataFrame:
    """Number exons from 1 within their transcript: by start on +, by end from the right otherwise; ties in file order."""
    exon = F.col("feature") == "exon"
    keyed = rows.withColumn("__tx", F.when(exon, attr("transcript_id")))
    exons = keyed.where("__tx IS NOT NULL")
    order = Window.partitionBy("__tx").orderBy(F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("end")), "rid")
    numbered = exons.withColumn("attrs", with_attr(key, F.row_number().over(order)))
    return numbered.unionByName(keyed.where("__tx IS NULL")).drop("__tx")


@operator("WIN-02", group="window")
def tss_numbering(rows: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, tss_number, dist_to_first_tss, nb_tss): dense rank of start sites 5' to 3' in each gene."""
    from locusframe.operators.project import transcripts_by_tss

    ranked = cut(transcripts_by_tss(rows))
    genes = ranked.groupBy("gene_id").agg(F.min(F.struct("tss_rank", "tss"))["tss"].alias("first"), F.max("tss_rank").alias("nb_tss"))
    return ranked.join(genes, "gene_id").select("gene_id", "transcript_id", F.col("tss_rank").alias("tss_number"), F.abs(F.col("tss") - F.col("first")).alias("dist_to_first_tss"), "nb_tss")


@operator("ORD-04", group="order")
def top_rows(rows: DataFrame, measure: str, n: int, ties: list[str]) -> DataFrame:
    """The n rows of greatest measure, ties by the given columns; each task keeps n rows before they meet."""
    return rows.orderBy(F.desc(measure), *ties).limit(n)
