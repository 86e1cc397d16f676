"""Sessions and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Settings that hold on any cluster: runtime re-planning, skew splitting and UTC clocks.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benches; on a cluster the submitted session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("locusframe")
    for key, value in TUNING.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers: once a context, unless they find it by PYTHONPATH or their folder."""
    package = Path(__file__).resolve().parent
    known = {Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if package.parent in known or getattr(spark.sparkContext, "_locusframe_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="locusframe-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/locusframe.zip", "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(f"{folder}/locusframe.zip")
    spark.sparkContext._locusframe_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, or by setCheckpointDir.

    Only where neither is set and the master is a single machine (tests), a folder of this machine, removed at the end; on a
    cluster executors would not see each other's files there, so that is an error.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if (folder := _LOCAL.get("folder")) and Path(folder).exists():
        return folder
    context = getattr(spark, "sparkContext", None)
    if context is not None and context.getCheckpointDir():
        return context.getCheckpointDir()
    if spark.conf.get("spark.master", "") != "local" and not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _LOCAL["folder"] = folder = tempfile.mkdtemp(prefix="locusframe-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_LOCAL: dict[str, str] = {}
#: Tables that were cut and not dropped yet.
_CUTS: dict[str, StructType] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and go on from its files.

    A lost executor then costs no recomputation beyond its running tasks, and later steps see the same rows. Operators that
    cut run this job while their plan is built.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/locusframe/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _CUTS[path] = df.schema
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def emptied(spark: SparkSession, path: str, schema: StructType) -> None:
    """Give a table's files back: it is overwritten by one without rows, which any session may do."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Give back the files of a cut table that no later step reads."""
    emptied(df.sparkSession, df._cut_path, df.schema)
    _CUTS.pop(df._cut_path, None)


def drop_cuts(spark: SparkSession) -> int:
    """Give back the files of all cut tables of this process, once the results made from them are stored; their number."""
    paths = list(_CUTS.items())
    for path, schema in paths:
        emptied(spark, path, schema)
        _CUTS.pop(path, None)
    return len(paths)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
