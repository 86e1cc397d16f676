"""References to records that do not exist: as-of matches against contiguous runs of parent keys, and times in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.skew import HOT_PARTS, hot_keys, replicated, salted
from locusframe.registry import operator
from locusframe.session import cut

#: Integer keys are cut into blocks of this many, so that no sorted stretch is longer than that in one task.
BLOCK = 1 << 16
SALTS = 64
FOREVER = "9999-12-31 00:00:00"


def key_parts(key: Column) -> list[Column]:
    """A string key as (family, number, block): the family is what precedes the final digits, with their count.

    Of more than 18 final digits the last 18 are the number. Keys without final digits are a family of their own with number 0.
    """
    digits = F.regexp_extract(key, r"\A(.*?)([0-9]{1,18})\z", 2)
    head = F.regexp_extract(key, r"\A(.*?)([0-9]{1,18})\z", 1)
    number = F.when(digits != "", digits.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    family = F.when(digits != "", F.concat_ws(":", head, F.length(digits))).otherwise(F.concat(F.lit("text:"), key))
    return [family.alias("family"), number.alias("number"), (F.floor(number / BLOCK)).cast("bigint").alias("block")]


def key_runs(parents: DataFrame, key: str, within: list[str]) -> DataFrame:
    """Distinct parent keys compressed to contiguous runs (within, family, block, run_start, run_end).

    A run ends at a missing number or at the end of its block. Null keys give nothing.
    """
    keys = parents.where(F.col(key).isNotNull()).select(*within, *key_parts(F.col(key))).distinct()
    order = Window.partitionBy(*within, "family", "block").orderBy("number")
    island = F.col("number") - F.row_number().over(order)
    return keys.withColumn("island", island).groupBy(*within, "family", "block", "island").agg(F.min("number").alias("run_start"), F.max("number").alias("run_end")).drop("island")


def beyond_runs(keys: DataFrame, runs: DataFrame, key: str, within: list[str]) -> DataFrame:
    """Those of the distinct keys that lie in no run: the preceding run start is matched as of the key, its end compared."""
    probes = keys.select(*within, F.col(key).alias("__key"), *key_parts(F.col(key))).withColumns({"at": F.col("number"), "kind": F.lit(1), "stop": F.lit(None).cast("bigint")})
    starts = runs.select(*within, F.lit(None).cast("string").alias("__key"), "family", F.col("run_start").alias("number"), "block", F.col("run_start").alias("at"), F.lit(0).alias("kind"), F.col("run_end").alias("stop"))
    preceding = Window.partitionBy(*within, "family", "block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = probes.unionByName(starts).withColumn("reach", F.last("stop", ignorenulls=True).over(preceding))
    return matched.where((F.col("kind") == 1) & (F.col("reach").isNull() | (F.col("number") > F.col("reach")))).select(*within, F.col("__key").alias(key))


@operator("REF-ORPHANS", group="quality")
def orphan_references(references: DataFrame, registry: DataFrame, total: int) -> DataFrame:
    """References without a registry row in force when they were loaded, with what is wrong.

    references: registry STRING, id STRING (returned form, referring to something), at TIMESTAMP, row_id LONG and any
    further columns, which are kept (one named kind is replaced). registry: registry, id, added_at, withdrawn_at (null: open). `total` is at
    least the number of references; it bounds the number of hot ids that are salted. The distinct ids with their counts, and
    the hot ones, are written once.

    Out come the reference's columns and `kind`: `missing` if the registry never has the id (as-of match of the
    distinct ids to runs of parent keys), else `late` if any of its rows was added after `at`, else `withdrawn`.
    A row is in force from added_at until before withdrawn_at. Null `at`: never in force, kind `missing` or `withdrawn`.
    Registry rows with null id are ignored, null added_at never come into force; identical rows change nothing.
    """
    extra = [c for c in references.columns if c.lower() not in ("registry", "id", "at", "row_id", "kind")]
    keep = [f"__k{i}" for i in range(len(extra))]
    references = references.select("registry", "id", "at", "row_id", *(F.col(f"`{c}`").alias(k) for c, k in zip(extra, keep, strict=True)))
    stamp = references.schema["at"].dataType.simpleString()
    both = ["registry", "id"]
    counts = cut(references.groupBy(*both).agg(F.count(F.lit(1)).alias("n")))
    parents = registry.where(F.col("id").isNotNull())
    missing = beyond_runs(counts, key_runs(parents, "id", ["registry"]), "id", ["registry"])
    hot = cut(hot_keys(counts, both, total))

    nothing = {c: F.lit(None).cast(references.schema[c].dataType) for c in ("row_id", *keep)}
    ever = F.lit(None).cast(stamp)

    def event(rows: DataFrame, kind: int, **values: Column) -> DataFrame:
        fill = {"at": ever, "stop": ever, "newest": ever, "never": F.lit(None).cast("boolean"), **nothing} | values
        return rows.select(*both, "salt", F.lit(kind).alias("step"), *(v.alias(k) for k, v in fill.items()))

    added, withdrawn = F.col("added_at").cast(stamp), F.coalesce(F.col("withdrawn_at").cast(stamp), F.lit(FOREVER).cast(stamp))
    newest = parents.groupBy(*both).agg(F.max(added).alias("newest"))
    periods = parents.where(F.col("added_at").isNotNull()).select(*both, added.alias("at"), withdrawn.alias("stop")).distinct()
    events = event(salted(references, hot, both, "row_id", SALTS), 2, at=F.col("at"), row_id=F.col("row_id"), **{c: F.col(c) for c in keep})
    events = events.unionByName(event(replicated(newest, hot, both, SALTS), 0, newest=F.col("newest")))
    events = events.unionByName(event(replicated(missing, hot, both, SALTS), 0, never=F.lit(True)))
    events = events.unionByName(event(replicated(periods, hot, both, SALTS), 1, at=F.col("at"), stop=F.col("stop")))

    # Markers come first, then everything by time; a period that starts at the very time of a reference counts.
    running = Window.partitionBy(*both, "salt").orderBy(F.col("step") != 0, F.col("at").asc_nulls_first(), "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumns({c: F.max(c).over(running) for c in ("stop", "newest", "never")})
    kind = F.when(F.col("never"), "missing").when(F.col("newest") > F.col("at"), "late").otherwise("withdrawn")
    in_force = F.coalesce(F.col("stop") > F.col("at"), F.lit(False))
    return seen.where((F.col("step") == 2) & ~in_force).select(*both, "at", "row_id", *(F.col(k).alias(c) for c, k in zip(extra, keep, strict=True)), kind.alias("kind"))


__all__ = ["HOT_PARTS", "beyond_runs", "key_parts", "key_runs", "orphan_references"]
