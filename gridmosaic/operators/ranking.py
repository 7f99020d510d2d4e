"""Positions and top-k choices that never put one whole group in one task.

A plain ``row_number`` sends a group to a single task. The functions here cut
a group into buckets that follow the sort order, number the rows inside each
bucket, and add the rows of the earlier buckets of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmosaic.session import reliable_checkpoint

HOT_GROUP_ROWS = 1_000_000


def seeded_key(seed: int | str, *cols: str | Column) -> Column:
    """Order key of every seeded choice: md5 of the seed and the row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def md5_bucket(key: Column, digits: int = 4) -> Column:
    """Leading hex digits: evenly filled, and in the order of the key."""
    return F.substring(key, 1, digits)


def position_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str = "position",
    hot_rows: int = HOT_GROUP_ROWS,
    hot_groups: DataFrame | None = None,
) -> DataFrame:
    """1-based position of each row in its group.

    ``bucket`` must not decrease along ``order``. Groups of up to ``hot_rows``
    rows form one bucket; only larger ones are cut, so ordinary groups cost one
    shuffle of the data. The list of hot groups, counted here if the caller
    does not know it, has at most rows / hot_rows entries. It is looked at
    first: without any, one window does it, and both ways give the same numbers.
    """
    group = list(group)
    if hot_groups is None:
        hot_groups = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    if hot_groups.isEmpty():
        place = F.row_number().over(W.partitionBy(*group).orderBy(*order))
        return df.withColumn(name, place.cast("bigint"))
    hot = hot_groups.select(*group, F.lit(True).alias("__hot"))
    marked = df.withColumn("__fine", bucket).join(hot, group, "left").withColumn(
        "__bucket", F.when(F.col("__hot"), F.col("__fine"))
    )
    before = W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.withColumn("__bucket", bucket)
        .join(hot, group, "left_semi")
        .groupBy(*group, "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = W.partitionBy(*group, "__bucket").orderBy(*order)
    return (
        marked.withColumn("__local", F.row_number().over(inside))
        .join(offsets, [*group, "__bucket"], "left")
        .withColumn(name, (F.coalesce(F.col("__offset"), F.lit(0)) + F.col("__local")).cast("bigint"))
        .drop("__bucket", "__fine", "__hot", "__local", "__offset")
    )


def global_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """1-based position of each row in the whole ordered input.

    A range-partitioned sort, one count per partition, and an add. The sorted
    rows are checkpointed first: counts and rows must see the same split.
    """
    pid = F.shiftright(F.col("__id"), 33)
    ordered = reliable_checkpoint(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    before = W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy(pid.alias("__pid"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        ordered.withColumn("__pid", pid)
        .join(offsets, "__pid")
        .withColumn(name, F.col("__offset") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("__id", "__pid", "__offset")
    )


def hashed_position(df: DataFrame, key: Column, tie: Sequence[str | Column] = (), name: str = "position", digits: int = 4) -> DataFrame:
    """1-based position in the order of an md5 key: needs no sort of the whole
    input, because the leading digits of the key are even buckets."""
    keyed = df.withColumn("__key", key).withColumn("__bucket", md5_bucket(F.col("__key"), digits))
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    inside = W.partitionBy("__bucket").orderBy("__key", *tie)
    return (
        keyed.withColumn("__local", F.row_number().over(inside))
        .join(offsets, "__bucket")
        .withColumn(name, (F.col("__offset") + F.col("__local")).cast("bigint"))
        .drop("__key", "__bucket", "__local", "__offset")
    )


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark limits every task's rows to k per
    group before the shuffle, so a hot group stays small."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k).withColumn(name, F.col(name).cast("bigint"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column, cols: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per key, by a partial aggregate."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in cols])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column, cols: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per key, by a partial aggregate."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in cols])
