"""Salting of hot keys: which keys are hot is measured over all rows, and their number is bounded by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one part in HOT_PARTS of all rows; so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 256


def hot_keys(counts: DataFrame, keys: list[str], total: int, count: str = "n") -> DataFrame:
    """Keys with more than total / HOT_PARTS rows, from a table of one row per key with its row count.

    At most HOT_PARTS - 1 rows can come out when total is the sum of all counts or more, whatever the data,
    so the result may be broadcast. An empty table gives no rows; null counts are never hot.
    """
    return counts.where(F.col(count) > F.lit(max(total, 1) / HOT_PARTS)).select(*keys)


def salted(rows: DataFrame, hot: DataFrame, keys: list[str], by: str, salts: int, salt: str = "salt") -> DataFrame:
    """Add a salt to the large side: a stable hash of column `by` for rows of hot keys, 0 for all others."""
    flag = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(F.col(by)), F.lit(salts)).cast("int")
    return rows.join(flag, keys, "left").withColumn(salt, F.when(F.col("__hot"), spread).otherwise(F.lit(0))).drop("__hot")


def replicated(rows: DataFrame, hot: DataFrame, keys: list[str], salts: int, salt: str = "salt") -> DataFrame:
    """The other side of a salted match: rows of hot keys once per salt, all others once with salt 0."""
    flag = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    all_salts = F.sequence(F.lit(0), F.when(F.col("__hot"), F.lit(salts - 1)).otherwise(F.lit(0)))
    return rows.join(flag, keys, "left").withColumn(salt, F.explode(all_salts)).drop("__hot")
