"""Overlapping and gapped intervals: continuous periods and the gaps between them, by session windows in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.labels import valid_span
from locusframe.registry import operator
from locusframe.session import cut

#: Positions are cut into blocks of this many; a hot group is spread over its blocks, and a block holds at most
#: this many distinct starts after pre-aggregation.
BLOCK = 1 << 20


@operator("IV-05", "PERIODS", group="intervals")
def periods_and_gaps(rows: DataFrame, keys: list[str], start: str = "start_pos", end: str = "end_pos", block: int = BLOCK) -> DataFrame:
    """1-based closed intervals per key -> (keys, kind, start, end): periods of covered positions and gaps between them.

    Every block of positions is merged on its own: a position is read as so many microseconds after the block's
    start, and a session window whose duration is the row's own length joins overlapping rows. These stretches are
    written once, as the rest reads them several times. What reaches beyond its block is carried over a per-block
    summary (a few rows per key). Touching periods are then joined and each gap and period end comes from the next
    period by lead. Joins by block are merged: rows are in the order of their blocks anyway, and neither they nor a summary
    that grows with keys and blocks is sent to every executor.
    Rows with a null key or an invalid span (null, start < 1, end < start) give nothing; repeated rows change nothing.
    """
    where = F.floor((F.col("s") - 1) / block).cast("bigint")
    spans = rows.where(valid_span(F.col(f"`{start}`"), F.col(f"`{end}`"))).select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{start}`").cast("bigint").alias("s"), F.col(f"`{end}`").cast("bigint").alias("e"))
    for k in keys:
        spans = spans.where(F.col(f"`{k}`").isNotNull())
    spans = spans.groupBy(*keys, "s").agg(F.max("e").alias("e")).withColumn("block", where)

    # Session windows inside a block; the part beyond the block's end only counts in max(e).
    offset = F.col("s") - F.col("block") * block
    inside = F.least(F.col("e") - F.col("s") + 1, F.lit(block) - offset + 1)
    length = F.make_interval(secs=(inside.cast("decimal(18,0)") / F.lit(1000000)).cast("decimal(18,6)"))
    timed = spans.withColumn("t", F.timestamp_micros(offset)).withColumn("length", length)
    local = cut(timed.groupBy(*keys, "block", F.session_window("t", F.col("length"))).agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("session_window"))

    # The furthest end of all earlier blocks, then of all earlier periods in the block.
    summary = local.groupBy(*keys, "block").agg(F.max("e").alias("far"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("carry", F.max("far").over(before)).select(*keys, "block", "carry")
    earlier = Window.partitionBy(*keys, "block").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    heads = local.withColumn("reach", F.max("e").over(earlier)).join(carried.hint("merge"), [*keys, "block"]).withColumn("reach", F.greatest("carry", "reach"))
    heads = heads.where(F.col("reach").isNull() | (F.col("s") > F.col("reach") + 1)).select(*keys, "block", "s", "reach")

    # A period ends where the next head says that everything before it ended; the last one at the key's furthest end.
    first = heads.groupBy(*keys, "block").agg(F.min_by("reach", "s").alias("first_reach"))
    after = Window.partitionBy(*keys).orderBy("block")
    following = summary.join(first.hint("merge"), [*keys, "block"], "left").select(
        *keys,
        "block",
        F.first("first_reach", ignorenulls=True).over(after.rowsBetween(1, Window.unboundedFollowing)).alias("next_reach"),
        F.max("far").over(Window.partitionBy(*keys)).alias("furthest"),
    )
    in_block = Window.partitionBy(*keys, "block").orderBy("s")
    ended = heads.withColumn("own_next", F.lead("reach").over(in_block)).join(following.hint("merge"), [*keys, "block"])
    ended = ended.withColumn("e", F.coalesce("own_next", "next_reach", "furthest"))
    period = F.struct(F.lit("period").alias("kind"), F.col("s").alias(start), F.col("e").alias(end))
    gap = F.struct(F.lit("gap").alias("kind"), (F.col("reach") + 1).alias(start), (F.col("s") - 1).alias(end))
    rows_out = ended.select(*keys, F.explode(F.array(period, F.when(F.col("reach").isNotNull(), gap))).alias("x")).where(F.col("x").isNotNull())
    return rows_out.select(*keys, "x.kind", F.col(f"x.{start}"), F.col(f"x.{end}"))
