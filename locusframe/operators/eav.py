"""Attribute-value rows into wide tables, as a log-structured store: sparse wide deltas per batch, then compaction."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.labels import DECIMAL, label, refers, trimmed
from locusframe.registry import operator
from locusframe.session import checkpoint_folder, emptied

#: Spellings of booleans and the type names of a declaration.
TRUE = ("true", "t", "yes", "1")
FALSE = ("false", "f", "no", "0")
SPARK_TYPE = {"string": "string", "long": "bigint", "double": "double", "boolean": "boolean"}
#: A cell of a delta, by the number of its key: version, number (of a long or a double, for ties) and text of the latest fitting
#: value, whether fitting values differ, and the values of a list key. Without a fitting value the text is null.
CELL = "struct<v:bigint,l:bigint,d:double,text:string,differ:boolean,items:array<struct<v:bigint,text:string>>>"
RUN = "entity {}, batch int, cells map<smallint," + CELL + ">"


def declared(types: DataFrame, most: int = 2000) -> list[tuple[str, str, bool]]:
    """(key, type, is_list) of every declared attribute, read to the driver: they become columns.

    The table is a schema, so its size is checked: more than `most` rows raise ValueError.
    """
    rows = types.select(label(F.col("attr_key")).alias("k"), "type_name", "is_list").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} declared attributes; a wide table of them would not be usable")
    return sorted((r["k"], r["type_name"], bool(r["is_list"])) for r in rows if r["k"])


def _fitting(value: Column, kind: Column) -> Column:
    """The value as text in one spelling per value of its declared type; null if it doesn't fit."""
    low = F.lower(value)
    long = F.when(value.rlike(r"\A[+-]?[0-9]{1,18}\z"), value.try_cast("bigint").cast("string"))
    double = F.when(value.rlike(DECIMAL), (value.try_cast("double") + F.lit(0.0)).cast("string"))
    boolean = F.when(low.isin(*TRUE), "true").when(low.isin(*FALSE), "false")
    return F.when(kind == "string", value).when(kind == "long", long).when(kind == "double", double).when(kind == "boolean", boolean)


def deltas(rows: DataFrame, types: list[tuple[str, str, bool]], entity: str, key: str, value: str, version: str, batch: Column | None = None) -> DataFrame:
    """Sparse wide deltas: one row (entity, batch, cells) per entity and batch, sorted by entity within each partition.

    `cells` maps the number of each declared key that has a value to its CELL, with the version of the newest fitting value.
    Without a batch column all rows are one batch; results don't depend on the batches. The values of a cell are taken together
    on the map side, so a hot entity sends one row per cell and task; only of list keys all distinct values meet, as they do in the result.
    Null entities and undeclared keys give nothing, nor do null, empty and marker values; but an entity with any row of a
    declared key has a delta, if an empty one.
    """
    number = {k: i for i, (k, _, _) in enumerate(types)}
    known = F.create_map(*[F.lit(x) for k, i in number.items() for x in (k, i)]) if types else F.lit(None).cast("map<string,int>")
    kinds = F.array(*[F.lit(t) for _, t, _ in types]) if types else F.array().cast("array<string>")
    lists = [i for i, (_, _, many) in enumerate(types) if many]
    text = trimmed(F.col(f"`{value}`"))
    flat = rows.select(F.col(f"`{entity}`").alias("entity"), (F.lit(0) if batch is None else batch).cast("int").alias("batch"), known[label(F.col(f"`{key}`"))].alias("k"), F.col(f"`{version}`").cast("bigint").alias("v"), F.when(refers(text), text).alias("given"))
    flat = flat.where(F.col("entity").isNotNull() & F.col("k").isNotNull()).withColumn("kind", F.get(kinds, F.col("k"))).withColumn("text", _fitting(F.col("given"), F.col("kind")))
    fits = F.col("text").isNotNull()
    flat = flat.withColumns({"l": F.when(F.col("kind") == "long", F.col("text").try_cast("bigint")), "d": F.when(F.col("kind") == "double", F.col("text").try_cast("double"))})
    listed = F.col("k").isin(*lists) if lists else F.lit(False)
    latest = F.max(F.when(fits, F.struct("v", "l", "d", "text")))
    measures = {"latest": latest, "low": F.min("text"), "high": F.max("text"), "some": F.max(F.col("given").isNotNull()), "items": F.collect_set(F.when(listed & fits, F.struct("v", "text")))}
    cells = flat.groupBy("entity", "batch", "k").agg(*(v.alias(c) for c, v in measures.items()))
    items = F.when(F.col("k").isin(*lists), F.col("items")) if lists else F.lit(None).cast("array<struct<v:bigint,text:string>>")
    cell = F.struct("latest.v", "latest.l", "latest.d", "latest.text", F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("differ"), items.alias("items"))
    entries = F.collect_list(F.when(F.col("some"), F.struct(F.col("k").cast("smallint").alias("k"), cell.alias("cell"))))
    return cells.groupBy("entity", "batch").agg(F.map_from_entries(entries).cast(f"map<smallint,{CELL}>").alias("cells")).sortWithinPartitions("entity")


def compacted(runs: DataFrame, types: list[tuple[str, str, bool]]) -> DataFrame:
    """Merge sorted runs of deltas into one row (entity, cells) per entity: per cell the latest version wins.

    A cell differs if it does in any run or if the runs' values do; list values are united. Ties of a version go to the greatest
    value. The deltas of an entity, one row a batch, come together in one shuffle, for both steps.
    """
    each = runs.select("entity", "cells").repartition("entity").select("entity", F.explode_outer("cells").alias("k", "c"))
    fits = F.col("c.text").isNotNull()
    measures = {"latest": F.max(F.when(fits, F.struct("c.v", "c.l", "c.d", "c.text"))), "low": F.min("c.text"), "high": F.max("c.text"), "differ": F.max("c.differ")}
    lists = [i for i, (_, _, many) in enumerate(types) if many]
    items = F.lit(None).cast("array<struct<v:bigint,text:string>>")
    if lists:
        measures["items"] = F.flatten(F.collect_list("c.items"))
        items = F.when(F.col("k").isin(*lists), F.array_distinct("items"))
    merged = each.groupBy("entity", "k").agg(*(v.alias(c) for c, v in measures.items()))
    differ = F.coalesce(F.col("differ") | (F.col("low") != F.col("high")), F.lit(False))
    cell = F.struct("latest.v", "latest.l", "latest.d", "latest.text", differ.alias("differ"), items.alias("items"))
    entries = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", cell.alias("cell"))))
    return merged.groupBy("entity").agg(F.map_from_entries(entries).cast(f"map<smallint,{CELL}>").alias("cells"))


@operator("EAV-WIDE", group="reshape")
def wide(store: DataFrame, types: list[tuple[str, str, bool]], entity: str = "rid") -> DataFrame:
    """Typed wide table from compacted cells: one row per entity, one column per declared key.

    Single-valued keys hold the fitting value of the highest version (ties: the greatest value), or null.
    List keys hold an array of the distinct (version, value) pairs' values in version order, or null.
    """

    columns = []
    for i, (k, kind, many) in enumerate(types):
        cell = F.col("cells")[F.lit(i).cast("smallint")]
        values = F.transform(F.array_sort(cell["items"]), lambda x: x["text"]).cast(f"array<{SPARK_TYPE[kind]}>")
        columns.append(F.when(F.size(values) > 0, values).alias(k) if many else cell["text"].cast(SPARK_TYPE[kind]).alias(k))
    return store.select(F.col("entity").alias(entity), *columns)


@operator("EAV-ISSUES", group="reshape")
def cell_issues(store: DataFrame, types: list[tuple[str, str, bool]], entity: str = "rid") -> DataFrame:
    """(entity, attr_key, issue) of compacted single-valued cells: `untypable` or `conflict`."""
    names = F.array(*[F.lit(k) for k, _, _ in types]) if types else F.array().cast("array<string>")
    single = [i for i, (_, _, many) in enumerate(types) if not many]
    cells = store.select(F.col("entity").alias(entity), F.explode("cells").alias("__k", "__c"))
    issue = F.when(F.col("__c.text").isNull(), "untypable").when(F.col("__c.differ"), "conflict")
    found = cells.where(F.col("__k").isin(*single) if single else F.lit(False)).select(entity, F.get(names, F.col("__k").cast("int")).alias("attr_key"), issue.alias("issue"))
    return found.where("issue IS NOT NULL")


def eav_cells(rows: DataFrame, types: list[tuple[str, str, bool]], entity: str = "rid", key: str = "attr_key", value: str = "attr_value", version: str = "pos", batches: int = 4, folder: str | None = None) -> DataFrame:
    """Compacted cells of a whole table, through the log: its rows come in so many batches, each a run of its own.

    A row's batch follows from its content. The log lies in a new part of the shared checkpoint folder, unless one is given.
    """
    spark = rows.sparkSession
    log = WideLog(spark, folder or f"{checkpoint_folder(spark)}/locusframe/log-{uuid.uuid4().hex}", types, rows.schema[entity].dataType.simpleString())
    log.upsert(rows, entity, key, value, version, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in (entity, key, value, version))), F.lit(batches)))
    return log.cells()


class WideLog:
    """A stored wide table: every upsert appends sorted runs of sparse deltas, compact() merges runs by cell version.

    The folder must be one that all executors share. What belongs to the table stands in a manifest: a row (number, runs) that is
    written anew after every change, the greatest number being in force. Runs are immutable; a run counts only from the manifest that
    names it on, and files that none names are given back. So a writer or an executor may be lost at any time, and another
    session goes on where the last manifest stands. One writer at a time is taken for granted.
    """

    def __init__(self, spark: SparkSession, folder: str, types: list[tuple[str, str, bool]], entity_type: str = "bigint") -> None:
        self.spark, self.folder, self.types, self.schema = spark, folder.rstrip("/"), types, RUN.format(entity_type)
        self.number, self.runs = 0, []
        try:
            found = spark.read.schema("number int, runs array<string>").json(f"{self.folder}/manifest").orderBy(F.desc("number")).limit(1).collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = []
        for row in found:
            self.number, self.runs = row["number"], list(row["runs"])

    def _stored(self, deltas: DataFrame) -> str:
        name = f"run-{self.number + 1:06d}-{uuid.uuid4().hex[:8]}"
        deltas.write.parquet(f"{self.folder}/{name}")
        return name

    def _commit(self, runs: list[str]) -> None:
        self.number, self.runs = self.number + 1, runs
        manifest = self.spark.createDataFrame([(self.number, runs)], "number int, runs array<string>")
        manifest.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def upsert(self, rows: DataFrame, entity: str = "rid", key: str = "attr_key", value: str = "attr_value", version: str = "pos", batch: Column | None = None) -> str:
        """Append attribute rows as one sorted run, which holds a delta per entity and batch; returns the run's name."""
        run = self._stored(deltas(rows, self.types, entity, key, value, version, batch))
        self._commit([*self.runs, run])
        return run

    def cells(self) -> DataFrame:
        """Compacted cells over all runs; no rows before the first upsert."""
        if not self.runs:
            return compacted(self.spark.createDataFrame([], self.schema), self.types)
        return compacted(self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{r}" for r in self.runs)), self.types)

    def compact(self) -> str:
        """Merge all runs into one run of one delta per entity; the files of the runs it replaces are given back."""
        old = list(self.runs)
        run = self._stored(self.cells().select("entity", F.lit(0).alias("batch"), "cells").sortWithinPartitions("entity"))
        self._commit([run])
        for name in old:
            emptied(self.spark, f"{self.folder}/{name}", self.spark.createDataFrame([], self.schema).schema)
        return run
