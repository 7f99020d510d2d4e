"""Samples, quotas and splits, all seeded by key order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmosaic.operators.ranking import global_position, hashed_position, md5_bucket, seeded_key, top_k

OTHERS = "Others"
NONE = "None"


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly n rows (all, if there are fewer), the first in seeded order.

    Counts per key bucket give the bucket that holds the n-th row; rows beyond
    it are filtered out before anything is shuffled.
    """
    keyed = df.withColumn("__key", seeded_key(seed, key)).withColumn("__bucket", md5_bucket(F.col("__key")))
    sizes = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    until = F.sum("__n").over(W.orderBy("__bucket"))
    reached = sizes.withColumn("__until", until).where(F.col("__until") >= n)
    cut = reached.agg(F.min(F.struct("__bucket", (F.col("__until") - F.col("__n")).alias("before"))).alias("cut")).scalar()
    near = keyed.withColumn("__cut", cut).where(F.col("__cut").isNull() | (F.col("__bucket") <= F.col("__cut.__bucket")))
    place = F.row_number().over(W.partitionBy("__bucket").orderBy("__key", key))
    first = F.col("__cut").isNull() | (F.col("__bucket") < F.col("__cut.__bucket")) | (F.col("__place") <= n - F.col("__cut.before"))
    return near.withColumn("__place", place).where(first).drop("__key", "__bucket", "__cut", "__place")


def seeded_order(df: DataFrame, seed: int, key: str, name: str = "position") -> DataFrame:
    """Position of each row in seeded order."""
    return hashed_position(df, seeded_key(seed, key), [key], name)


def dominant_category(df: DataFrame, id_col: str, categories: str = "categories", mode: str = "first") -> DataFrame:
    """One category per row: the ``first`` listed, or the most ``frequent`` one
    in the whole input (ties by name)."""
    if mode == "first":
        return df.select(id_col, F.get(categories, F.lit(0)).alias("category"))
    rows = df.select(id_col, F.explode(categories).alias("category"))
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(counts, "category").groupBy(id_col).agg(
        F.min_by("category", F.struct((-F.col("n")).alias("n"), "category")).alias("category")
    )


def question_categories(questions: DataFrame, tables: DataFrame, page_entity: DataFrame, entity_classes: DataFrame) -> DataFrame:
    """Question to table to page to entity to its list of classes; a gap or an
    empty list gives the class ``None``. ``entity_classes``: qid, categories."""
    chain = (
        questions.select("question_id", F.col("table_context").alias("table_id"))
        .join(tables.select("table_id", "url"), "table_id", "left")
        .join(page_entity.select("url", "qid"), "url", "left")
        .join(entity_classes.select("qid", "categories"), "qid", "left")
    )
    listed = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit(NONE)))
    return chain.select("question_id", listed.alias("categories"))


def quotas(frequency: DataFrame, total: DataFrame, n: int) -> DataFrame:
    """Sample sizes: frequent categories get their share of n, rounded down; the
    rest goes to ``Others``. ``frequency``: category, n. ``total``: one row N."""
    size = total.select("N").scalar()
    limit = F.least(0.02 * size, F.lit(20.0))
    kept = frequency.where(F.col("n") > limit).select(
        "category", F.floor(F.lit(n) * F.col("n") / size).cast("bigint").alias("quota")
    )
    rest = kept.agg((F.lit(n) - F.coalesce(F.sum("quota"), F.lit(0))).cast("bigint").alias("quota")).select(F.lit(OTHERS).alias("category"), "quota")
    return kept.unionByName(rest)


def stratified_sample(df: DataFrame, quota: DataFrame, id_col: str, seed: int, category: str = "category") -> DataFrame:
    """Up to its quota from each stratum, in seeded order; categories without a
    quota of their own form ``Others``.

    The largest quota limits what a task keeps of a stratum before the shuffle,
    so a stratum sends tasks times that many rows at most, whatever its size.
    """
    named = quota.select(F.col("category").alias("stratum"), F.col("quota"))
    strata = (
        df.join(named.select(F.col("stratum").alias(category), F.lit(True).alias("__own")), category, "left")
        .withColumn("stratum", F.when(F.col("__own"), F.col(category)).otherwise(F.lit(OTHERS))).drop("__own")
        .withColumn("__key", seeded_key(seed, id_col))
    )
    largest = quota.agg(F.max("quota")).first()[0] or 0
    ranked = top_k(strata, ["stratum"], [F.col("__key"), F.col(id_col)], largest, "__place")
    return ranked.join(named, "stratum").where(F.col("__place") <= F.col("quota")).drop("__key", "__place", "quota")


def shortfalls(sample: DataFrame, quota: DataFrame) -> DataFrame:
    """Quota, taken and missing per stratum."""
    taken = sample.groupBy(F.col("stratum").alias("category")).agg(F.count(F.lit(1)).alias("taken"))
    return quota.join(taken, "category", "left").select(
        "category", "quota", F.coalesce("taken", F.lit(0)).alias("taken"), (F.col("quota") - F.coalesce("taken", F.lit(0))).alias("missing")
    )


def split_prefix(df: DataFrame, order: Sequence[str | Column], share: float = 0.8) -> DataFrame:
    """``train`` for the first floor(share * n) rows in order, else ``test``."""
    placed = global_position(df, order, "__place")
    n = placed.agg(F.count(F.lit(1))).scalar()
    return placed.withColumn("split", F.when(F.col("__place") <= F.floor(F.lit(share) * n), "train").otherwise("test")).drop("__place")


def table_split(train: DataFrame, test: DataFrame, key: str = "table_context") -> DataFrame:
    """Tables used by training questions only, by test questions only, or both."""
    a = train.select(key).distinct().withColumn("__a", F.lit(True))
    b = test.select(key).distinct().withColumn("__b", F.lit(True))
    kind = F.when(F.col("__a") & F.col("__b"), "common").when(F.col("__a"), "train_only").otherwise("test_only")
    return a.join(b, key, "full_outer").select(key, kind.alias("split"))


def exclusive_questions(questions: DataFrame, split: DataFrame, kind: str = "train_only", key: str = "table_context") -> DataFrame:
    """Questions on tables of one kind of the table split."""
    return questions.join(split.where(F.col("split") == kind), key, "left_semi")
