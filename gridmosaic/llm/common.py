"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SHARED_FOLDER = "spark.checkpoint.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 500  # whole texts in an Arrow batch


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session without one gets a scratch folder; elsewhere a missing setting is an error.
    """
    folder = spark.conf.get(SHARED_FOLDER, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SHARED_FOLDER} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="gridmosaic-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write rows to the shared folder as Parquet and read them from there.

    Cuts the lineage and keeps a table that later steps read several times, with columns still pruned. Python steps of `df` get
    at most `batch_rows` rows at a time, if given, and not more than the session allows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = int(spark.conf.get(BATCH_ROWS))
    if batch_rows is not None and not 0 < before <= batch_rows:
        spark.conf.set(BATCH_ROWS, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_interval(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the values only: the same in every run."""
    parts = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def hashed_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n rows, those with the smallest hashes of the keys: the same in every run.

    Rows are counted first and all but about one and a half times n filtered out by their hash, so that the tasks together, and
    not each of them, send about that many to be put in order.
    """
    place = F.shiftrightunsigned(F.xxhash64(*keys), 33)
    cut = min(1 << 31, int((1 << 31) * (1.5 * n + 50) / max(1, df.count())))
    return df.filter(place < cut).orderBy(place, *keys).limit(n)
