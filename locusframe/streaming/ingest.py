"""Continuous ingestion of annotation lines: sound rows and rejects are appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from locusframe.operators.quarantine import classify_lines


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New text files of a folder as a stream of raw_line and src_file."""
    return spark.readStream.text(folder).select(F.col("value").alias("raw_line"), F.input_file_name().alias("src_file"))


def quarantine_stream(lines: DataFrame, good: str, bad: str, progress: str, once: bool = True) -> StreamingQuery:
    """Classify every batch once and append its two parts to Parquet folders; the batch number is a partition column,
    so a batch that is repeated after a failure replaces itself instead of being written twice."""

    def store(batch: DataFrame, number: int) -> None:
        judged = classify_lines(batch).persist()
        judged.where("is_record AND reason IS NULL").drop("reason", "is_record", "corrupt_text").write.mode("overwrite").parquet(f"{good}/batch={number}")
        judged.where("reason IS NOT NULL").select("raw_line", "src_file", "reason").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        judged.unpersist()

    writer = lines.writeStream.option("checkpointLocation", progress).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
