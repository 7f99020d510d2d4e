"""Resuming as a stream: result lines land in a folder, and of each key the
last result is kept, by the time of its file and its place there, in whatever
order the files are read. The checkpoint folder holds what was read, so a
restarted stream goes on where the lost one stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridmosaic.sources.sinks import frontier

RESULT_SCHEMA = "key string, value string"


def landed_results(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of result lines (key, value) with ``landed``, the time and path of their file and the offset of the piece read; null values are not results."""
    lines = spark.readStream.schema(RESULT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    landed = F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
    )
    return lines.select("key", "value", landed.alias("landed")).where(F.col("value").isNotNull())


def keep_results(stream: DataFrame, table_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append new results to a Parquet table, one folder per batch.

    A batch that is written again after a failure replaces its own folder, so
    no result is stored twice.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        # lines of a piece are read in order, by one task
        numbered = batch.withColumn("landed", F.struct("landed.*", F.monotonically_increasing_id().alias("line")))
        last = numbered.groupBy("key").agg(F.max_by("value", "landed").alias("value"), F.max("landed").alias("landed"))
        last.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stored_results(spark: SparkSession, table_path: str) -> DataFrame:
    """Results kept so far, one row per key: the one that landed last. A file that is read late does not win over a later one."""
    return spark.read.parquet(table_path).groupBy("key").agg(F.max_by("value", "landed").alias("value"))


def open_keys(spark: SparkSession, inputs: DataFrame, table_path: str) -> DataFrame:
    """Keys whose result has not landed yet."""
    return frontier(inputs, stored_results(spark, table_path), "key")
