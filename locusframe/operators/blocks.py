"""Ranks, running sums and as-of look-ups along a line, cut into blocks so that no task holds a whole group.

A group (a chromosome, a gene) may hold a third of all rows. Its places are cut into blocks of a fixed number of positions;
what earlier blocks add up to is carried over a summary of one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per block; after repeated places are taken together a block holds at most so many rows.
BLOCK = 1 << 20


def block_of(place: Column, block: int = BLOCK) -> Column:
    """Number of the block that a place lies in."""
    return F.floor(place / block).cast("bigint")


def carried(rows: DataFrame, keys: list[str], number: str, **measures: Column) -> DataFrame:
    """(keys, number, measures): per block the sum of each measure over all earlier blocks of the group; 0 for the first."""
    sums = rows.groupBy(*keys, number).agg(*(F.sum(v).alias(k) for k, v in measures.items()))
    before = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, number, *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in measures))


def summed_before(rows: DataFrame, keys: list[str], place: str, name: str, measure: Column, block: int = BLOCK) -> DataFrame:
    """The rows with `name`: the sum of a measure over the rows of lower place in their group. Places are distinct in a group."""
    cut = rows.withColumns({"__block": block_of(F.col(place), block), "__m": measure})
    inside = Window.partitionBy(*keys, "__block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("__own", F.coalesce(F.sum("__m").over(inside), F.lit(0)))
    return own.join(carried(cut, keys, "__block", __before=F.col("__m")), [*keys, "__block"]).withColumn(name, F.col("__before") + F.col("__own")).drop("__block", "__m", "__own", "__before")


def ranked_places(places: DataFrame, keys: list[str], place: str = "place", block: int = BLOCK) -> DataFrame:
    """Places that are distinct within their keys, with `rank` from 1 in their order; further columns are kept."""
    return summed_before(places, keys, place, "rank", F.lit(1), block).withColumn("rank", F.col("rank") + 1)


def rank_upto(probes: DataFrame, ranked: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, at) in any number -> distinct, with `upto`, the greatest rank of a place <= at (0 if there is none).

    ranked: keys, place, rank, the rank growing with the place; places may repeat.
    """
    asked = probes.select(*keys, "at").distinct().select(*keys, F.col("at").alias("place"), F.lit(None).cast("bigint").alias("rank"), F.lit(1).alias("probe"))
    known = ranked.groupBy(*keys, "place").agg(F.max("rank").cast("bigint").alias("rank")).withColumn("probe", F.lit(0))
    events = known.unionByName(asked).withColumn("__block", block_of(F.col("place"), block))
    tops = events.groupBy(*keys, "__block").agg(F.max("rank").alias("top"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "__block", F.max("top").over(earlier).alias("carry"))
    running = Window.partitionBy(*keys, "__block").orderBy("place", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("own", F.max("rank").over(running)).where("probe = 1").join(tops, [*keys, "__block"])
    return seen.select(*keys, F.col("place").alias("at"), F.coalesce("own", "carry", F.lit(0).cast("bigint")).alias("upto"))
