"""Frames whose rows of a table, a cell or a tag lie in one task, and joins that leave them there.

Spark deals both sides of a join anew by all its keys, also where both lie by some of
them already. Groups and windows take such frames as they are, so the joins here go by a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def dealt(df: DataFrame, key: str, whole: bool = True) -> DataFrame:
    """Rows dealt by ``key``, if its groups are known to be ``whole``: small enough for one task each. Rows that lie so already stay."""
    return df.repartition(key) if whole else df


_MARKS = count()


def stacked(frames: Sequence[DataFrame], key: str, name: str | None = None) -> DataFrame:
    """The union of frames that lie by ``key``. Where rows meet in it at once, the key gets a ``name`` that stays until then.

    Spark 4.1 takes such a union for dealt, but compares the columns the frames are dealt by
    again as it runs, when the same column may look another one (whether it can be missing is
    told anew if a shuffle is another's). It is then a plain union, and equal rows do not
    meet. A column under a new name, or with a mark of its own, is one and the same for its frame, before and then.
    """
    mark = {"dealt": next(_MARKS)}
    named = [df.withColumnRenamed(key, name) if name else df.withColumn(key, F.col(key).alias(key, metadata=mark)) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def met(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", loose: Sequence[str] = ()) -> DataFrame:
    """The join on ``keys`` (``inner``, ``left``, ``semi`` or ``anti``) of frames that lie by the first of them.

    As in a join, missing keys are equal to none, but for ``loose`` ones, and each pair of equal rows gives one. The
    rows of ``right`` with one key are gathered, so they have to be few where they are joined.
    """
    keys = list(keys)
    there = right.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys if k not in loose]))
    at = "__at"  # the first key, which both lie by
    same = W.partitionBy(at, *keys[1:])
    own = [F.col(at).alias(c) if c == keys[0] else F.col(c) for c in left.columns]
    mine = left.withColumn("__own", F.lit(True))
    if how in ("semi", "anti"):
        both = stacked([mine.withColumn("__met", F.lit(False)), there.select(*keys, F.lit(False).alias("__own"), F.lit(True).alias("__met"))], keys[0], at)
        found = both.withColumn("__met", F.max("__met").over(same)).where("__own")
        return found.where("__met" if how == "semi" else "NOT __met").select(*own)
    rest = [c for c in right.columns if c not in keys]
    both = stacked([mine, there.select(*keys, F.lit(False).alias("__own"), F.struct(*rest).alias("__known"))], keys[0], at)
    rows = both.withColumn("__known", F.collect_list("__known").over(same)).where("__own")
    opened = (F.explode if how == "inner" else F.explode_outer)("__known").alias("__known")
    return rows.select(*own, opened).select(*left.columns, *[F.col(f"__known.{c}").alias(c) for c in rest])
