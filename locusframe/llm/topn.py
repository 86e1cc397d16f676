"""Top N items within every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Subgroups that the items of one group are hashed into in the first stage.
SALTS = 32


def top_n(rows: DataFrame, groups: list[str], order: list[Column], ties: list[str], n: int, rank: str = "rank_no", salts: int = SALTS) -> DataFrame:
    """The n first rows of every group by `order`, then by the columns `ties` ascending; `rank` numbers them from 1.

    First each group is hashed by its tie columns into subgroups and at most n rows of each subgroup are kept
    (Spark also cuts every map task's share to n before the shuffle); then the survivors, at most n * salts a group,
    are ranked. A group of any size is thus spread over `salts` tasks and no task holds more than its share.
    Rows with equal order and tie columns are told apart by nothing and may swap ranks, but the ranks given are
    the same. Null groups form a group of their own; nulls in tie columns come first. All columns are kept.
    """
    salt = F.pmod(F.xxhash64(*ties, F.lit(17)), F.lit(salts)).alias("__salt")
    by_order = [*order, *(F.col(f"`{t}`").asc() for t in ties)]
    inner = Window.partitionBy(*(F.col(f"`{g}`") for g in groups), "__salt").orderBy(*by_order)
    outer = Window.partitionBy(*(F.col(f"`{g}`") for g in groups)).orderBy(*by_order)
    survivors = rows.select("*", salt).withColumn("__rank", F.row_number().over(inner)).where(F.col("__rank") <= n).drop("__salt", "__rank")
    return survivors.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n)


def best_scores(rows: DataFrame, groups: list[str], item: str, score: str) -> DataFrame:
    """One row per group and item with its greatest score; combined on the map side, so a hot group shuffles items only."""
    return rows.groupBy(*groups, item).agg(F.max(score).alias(score))
