"""Numeric tracks (track, chrom, start, end, value) summed up over regions, bins and profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.conditions import condition
from locusframe.operators.intervals import flank, merge, overlap_join
from locusframe.registry import operator


def cut_bins(regions: DataFrame, bins: int) -> DataFrame:
    """Each region in `bins` parts of equal width, the last one taking the rest; shorter regions give none."""
    width = F.floor((F.col("end") - F.col("start")) / bins).cast("bigint")
    each = regions.withColumn("__w", width).where("__w > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    first = F.col("start") + F.col("bin") * F.col("__w")
    return each.withColumns({"start": first, "end": F.when(F.col("bin") == bins - 1, F.col("end")).otherwise(first + F.col("__w"))}).drop("__w")


@operator("SIG-03", group="signal")
def binned_signal(regions: DataFrame, signal: DataFrame, tracks: list[str], bins: int = 1, stat: str = "mean", zero_to_na: bool = False, pseudo_count: float = 0.0, stranded: bool = False) -> DataFrame:
    """(rid, track, bin, value): mean (or sum) of the signal over the bases of every bin, rounded to 6 places.

    Bases without signal count 0; with zero_to_na a bin of 0 is null. stranded counts the bins of - regions backwards.
    `tracks` are the tracks asked for, so that bins without any signal come out too. regions need a unique rid.
    """
    cut = cut_bins(regions.select("rid", "chrom", "start", "end", "strand"), bins)
    met = overlap_join(cut, signal.where(F.col("track").isin(tracks)).select("track", "chrom", "start", "end", "value"))
    sums = met.groupBy("rid", "bin", F.col("track_b").alias("track")).agg(F.sum(F.col("value_b") * (F.col("ov_end") - F.col("ov_start"))).alias("total"))
    every = cut.withColumn("track", F.explode(F.array(*[F.lit(t) for t in tracks]))).join(sums, ["rid", "bin", "track"], "left")
    total = F.coalesce("total", F.lit(0.0))
    value = F.round(total / (F.col("end") - F.col("start")) if stat == "mean" else total, 6)
    value = F.when(value != 0, value + pseudo_count) if zero_to_na else value + pseudo_count
    index = F.when(F.lit(stranded) & (F.col("strand") == "-"), bins - 1 - F.col("bin")).otherwise(F.col("bin"))
    return every.select("rid", "track", index.cast("int").alias("bin"), value.alias("value"))


@operator("SIG-01", "SIG-02", "ORD-05", group="signal")
def coverage(regions: DataFrame, signal: DataFrame, tracks: list[str], bins: int = 1, n_highest: int | None = None, stat: str = "mean", zero_to_na: bool = False, pseudo_count: float = 1.0) -> DataFrame:
    """(rid, track, cov): mean over a region's bins, or over its n highest. Regions shorter than `bins` get the pseudo-count."""
    values = binned_signal(regions, signal, tracks, bins, stat, zero_to_na, pseudo_count)
    best = F.sort_array(F.collect_list("value"), asc=False)
    top = F.slice(best, 1, n_highest or bins)
    mean = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    found = values.groupBy("rid", "track").agg(F.when(F.size(best) > 0, mean).alias("cov"), F.count(F.lit(1)).alias("n"))
    every = regions.select("rid", F.explode(F.array(*[F.lit(t) for t in tracks])).alias("track"))
    short = F.lit(None).cast("double") if zero_to_na else F.lit(pseudo_count)
    return every.join(found, ["rid", "track"], "left").select("rid", "track", F.when(F.col("n").isNull(), short).otherwise(F.col("cov")).alias("cov"))


def coverage_matrix(cov: DataFrame, tracks: list[str]) -> DataFrame:
    """One row per region, one column per track."""
    return cov.groupBy("rid").pivot("track", tracks).agg(F.first("cov"))


@operator("SIG-04", group="signal")
def signal_matrix(regions: DataFrame, signal: DataFrame, sizes: DataFrame, tracks: list[str], bins: int = 100, around: float = 0.1, upstream: int = 1000, downstream: int = 1000, pseudo_count: float = 0.0, stranded: bool = True) -> DataFrame:
    """(rid, track, part, bin, value): bins of regions (main) and of their flanks (up, down), in long form."""
    side_bins = max(1, round(bins * around))
    sides = flank(regions, sizes, upstream, downstream, stranded)
    main = binned_signal(regions, signal, tracks, bins, pseudo_count=pseudo_count, stranded=stranded).withColumn("part", F.lit("main"))
    parts = [binned_signal(sides.where(F.col("side") == s), signal, tracks, side_bins, pseudo_count=pseudo_count, stranded=stranded).withColumn("part", F.lit(s)) for s in ("up", "down")]
    return main.unionByName(parts[0]).unionByName(parts[1]).select("rid", "track", "part", "bin", "value")


@operator("SIG-05", group="signal")
def normalized(values: DataFrame, upper: float | None = 0.95, log: bool = False, ranging: bool = False) -> DataFrame:
    """Profile values (track, value, ...): cut at a percentile of the track's distinct values, log2 (of 1 more if any is 0), 0 to 100."""
    out = values
    if upper is not None:
        tops = out.select("track", "value").distinct().groupBy("track").agg(F.percentile("value", F.lit(upper)).alias("__top"))
        out = out.join(tops, "track").withColumn("value", F.least("value", "__top")).drop("__top")
    if log:
        zero = out.agg(F.max((F.col("value") == 0).cast("int")).alias("__zero"))
        shift = zero.first()["__zero"] or 0
        out = out.withColumn("value", F.log2(F.col("value") + shift))
    if ranging:
        ends = out.groupBy("track").agg(F.min("value").alias("__l"), F.max("value").alias("__h"))
        scaled = F.when(F.col("__h") > F.col("__l"), 100 * (F.col("value") - F.col("__l")) / (F.col("__h") - F.col("__l"))).otherwise(F.lit(0.0))
        out = out.join(ends, "track").withColumn("value", scaled).drop("__l", "__h")
    return out


@operator("SIG-06", group="signal")
def signal_runs(signal: DataFrame, test: str) -> DataFrame:
    """(track, chrom, start, end): runs of adjacent segments whose value `s` meets a condition; gaps end a run, empty segments are none."""
    hit, _ = condition(test, lambda key: F.col("value") if key == "s" else F.raise_error(F.lit(f"unknown name: {key}")).cast("double"))
    return merge(signal.where(hit), ("track",))


#: Genes of one group above which the sequential matching is refused.
MOST_MATCHED = 2_000_000


@operator("SIG-07", group="signal")
def matched_controls(genes: DataFrame, group: str = "group", log: bool = True, pseudo_count: float = 1.0) -> DataFrame:
    """(group, gene, control): for every reference gene in order of id the unused other gene nearest in expression.

    genes: group, gene, expression, is_reference. Ties go to the least id. The choice depends on all earlier ones,
    so one group is matched in one task; a group of more than MOST_MATCHED genes raises. Genes of one expression are used
    up in order of id and then passed over, so the work grows with the number of genes however many are alike.
    """
    level = F.log2(F.col("expression") + pseudo_count) if log else F.col("expression")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > MOST_MATCHED:
            raise ValueError(f"more than {MOST_MATCHED} genes in one group")
        rows = rows.dropna(subset=["x", "gene"])
        pool = rows[~rows["is_reference"]].sort_values(["x", "gene"], kind="stable")
        names = pool["gene"].to_numpy()
        xs, first = np.unique(pool["x"].to_numpy(), return_index=True)
        following, last = first.copy(), np.append(first[1:], len(names))
        # Levels used up are passed over; places are shifted by one, so that 0 and the last one are the ends.
        down, up = np.arange(len(xs) + 1), np.arange(len(xs) + 1)

        def root(links: np.ndarray, i: int) -> int:
            while links[i] != i:
                links[i] = links[links[i]]
                i = links[i]
            return i

        out = []
        for gene, x in rows[rows["is_reference"]].sort_values("gene")[["gene", "x"]].itertuples(index=False):
            i = int(np.searchsorted(xs, x, side="left"))
            sides = [(abs(xs[j] - x), names[following[j]], j) for j in (root(down, i) - 1, root(up, i)) if 0 <= j < len(xs)]
            if not sides:
                break
            _, name, best = min(sides)
            following[best] += 1
            if following[best] == last[best]:
                down[best + 1], up[best] = best, best + 1
            out.append((rows[group].iloc[0], gene, name))
        return pd.DataFrame(out, columns=["group", "gene", "control"])

    given = genes.select(F.col(group).cast("string").alias(group), F.col("gene").cast("string").alias("gene"), level.cast("double").alias("x"), F.col("is_reference").cast("boolean").alias("is_reference"))
    return given.groupBy(group).applyInPandas(match, "group string, gene string, control string")
