"""Files out, and the bookkeeping of repeated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridmosaic.operators.ranking import global_position

REQUESTS_PER_FILE = 100


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as JSON lines, one file per task; nulls are written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def record_lines(df: DataFrame, name: str = "line") -> DataFrame:
    """Rows as the JSON texts that ``write_jsonl`` writes."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_json_map(df: DataFrame, key: str, value: str, path: str, mode: str = "errorifexists") -> None:
    """One JSON object ``{key: value, ...}``, an entry per line in key order.

    The lines are sorted by range, so a large object is several files, which
    give the object one after another. Keys are strings and unique.
    """
    entry = F.to_json(F.create_map(F.col(key).cast("string"), F.col(value)), {"ignoreNullFields": "false"})
    rows = df.select(F.lit(1).alias("at"), F.col(key).cast("string").alias("k"), F.substring(entry, F.lit(2), F.length(entry) - 2).alias("value"))
    first = rows.agg(F.min("k")).scalar()
    rows = rows.withColumn("value", F.concat(F.when(F.col("k") == first, "").otherwise(","), "value"))
    frame = df.sparkSession.range(2).select(
        F.when(F.col("id") == 0, 0).otherwise(2).alias("at"), F.lit("").alias("k"), F.when(F.col("id") == 0, "{").otherwise("}").alias("value")
    )
    rows.unionByName(frame).orderBy("at", "k").select("value").write.mode(mode).text(path)


def chunk_requests(df: DataFrame, order_col: str, size: int = REQUESTS_PER_FILE) -> DataFrame:
    """Request file number of every row: file i holds rows [size * i, size * (i + 1)) in order."""
    placed = global_position(df, [order_col], "__place")
    return placed.withColumn("chunk", F.floor((F.col("__place") - 1) / size)).drop("__place")


def write_chunks(df: DataFrame, path: str, line: str = "request", mode: str = "errorifexists", order: tuple[str, ...] = ()) -> None:
    """Chunked request lines in order, one folder with one file per chunk; ``order`` sorts the lines of a chunk."""
    rows = df.repartition("chunk").sortWithinPartitions("chunk", *order)
    rows.select(F.col(line).alias("value"), "chunk").write.mode(mode).partitionBy("chunk").text(path)


def frontier(inputs: DataFrame, done: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Distinct keys still to be processed: those with no saved result, or a null one."""
    return inputs.select(key).distinct().join(done.where(F.col(value).isNotNull()).select(key), key, "left_anti")


def merge_results(old: DataFrame, new: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Saved results with the new ones over them. Both have one row per key."""
    return old.select(key, F.col(value).alias("__old")).join(new.select(key, F.col(value).alias("__new")), key, "full_outer").select(
        key, F.coalesce("__new", "__old").alias(value)
    )
