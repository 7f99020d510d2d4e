"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmosaic.llm.common import n_words, stage, unit_interval

SEED = 20240501
BUCKETS = 4096


def targets(totals: DataFrame, weights: tuple[float, ...], max_copies: float, total: float | None = None) -> DataFrame:
    """Words each source should give.

    `totals` has one row per source (`source`, `source_size`). Sources in code point order, null last, weigh
    `weights`, repeated. The targets share `total` (default: all words) by weight, and a target stops at
    `max_copies` times its source; what it cannot give goes to the others by weight. In the order of cap over
    weight the capped sources come first, so one running sum finds the level at which the rest share.
    Returns `totals` with `target`.
    """
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("weight", F.element_at(choices, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(float(max_copies)) * F.col("source_size"))
    weighed = weighed.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    wanted = F.sum("source_size").over(everything).cast("double") if total is None else F.lit(float(total))
    leveled = weighed.withColumn("level", (wanted - before) / rest)
    # Among uncapped sources the first in this order has the true level, and those after it a level no lower.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return leveled.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * level, "cap"))).select("source", "source_size", "target")


def _boundary(rows: DataFrame, bucket: Column, need: Column) -> DataFrame:
    """The bucket of each source in which the running sum of sizes passes `need`, and the sum before it."""
    sums = rows.groupBy("source", bucket.alias("b"), need.alias("need")).agg(F.sum("size").alias("words"))
    order = W.partitionBy("source").orderBy("b")
    run = sums.withColumn("until", F.sum("words").over(order))
    return run.filter(F.col("until") > F.col("need")).groupBy("source").agg(
        F.min("b").alias("b"), F.min_by(F.col("until") - F.col("words"), "b").alias("before"), F.first("need").alias("need"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_copies: float = 3.0,
    total: float | None = None,
    importance: str | None = None,
    seed: int = SEED,
) -> DataFrame:
    """How often each document enters a mix whose sources have given shares of words.

    `docs` has `doc_id`, `text`, `source`. A document of importance w (column `importance`, else 1) should enter
    `target / source_size * w / mean w` times, at most `max_copies`. The whole part is certain. The fraction is its
    inclusion chance p, and documents of a source are ranked by (u / (1 - u)) / (p / (1 - p)) with u fixed by seed and doc_id:
    Pareto order sampling. The sample is the run of lowest ranks whose words fit into what the whole copies leave of the target,
    and then the one document that fits the remaining gap best, if it lowers it.

    The cut is found without sorting a source in one task: sums per 4096 rank buckets, again inside the bucket where
    the target is reached, and a window over what is left of it, at every size.

    Null or empty text: size 0, taken 0. A null source is a source. Rows equal in doc_id and size have equal ranks
    and go together. Other columns are dropped. Empty table: no rows.
    Returns doc_id, size, source_size, target, taken (words, repeats counted), source, copies.
    """
    w = F.lit(1.0) if importance is None else F.coalesce(F.col(importance).cast("double"), F.lit(1.0))
    sized = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), w.alias("importance")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("importance")).alias("weighted"))
    plan = targets(totals.select("source", "source_size"), weights, max_copies, total).alias("t").join(
        totals.select(F.col("source").alias("s"), "weighted"), F.col("t.source").eqNullSafe(F.col("s"))).drop("s")

    share = F.when(F.col("weighted") > 0, F.col("target") / F.col("weighted") * F.col("importance")).otherwise(F.lit(0.0))
    joined = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.doc_id", "d.source", "size", "source_size", "target", F.least(share, F.lit(float(max_copies))).alias("share"), unit_interval(seed, F.col("d.doc_id")).alias("u"))
    whole = F.floor("share")
    chance = F.col("share") - whole
    odds = F.col("u") * (1 - chance)
    ranked = joined.withColumn("whole", whole).withColumn("rank", F.when((chance > 0) & (F.col("size") > 0), odds / (odds + chance * (1 - F.col("u")))))
    ranked = stage(ranked.select("doc_id", "source", "size", "source_size", "target", "whole", "rank"), "mix-ranks")

    left = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("left"))
    candidates = ranked.filter(F.col("rank").isNotNull()).alias("r").join(left.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source"))).select(
        "r.doc_id", "r.source", "size", "rank", "left")
    coarse, fine = F.floor(F.col("rank") * BUCKETS), F.floor(F.col("rank") * BUCKETS * BUCKETS)
    first = _boundary(candidates, coarse, F.col("left")).select(F.col("source").alias("s1"), F.col("b").alias("b1"), F.col("before").alias("before1"))
    inside = candidates.join(first, F.col("source").eqNullSafe(F.col("s1")) & (coarse == F.col("b1"))).withColumn("left", F.col("left") - F.col("before1"))
    second = _boundary(inside, fine, F.col("left")).select(F.col("source").alias("s2"), F.col("b").alias("b2"), F.col("before").alias("before2"), F.col("need").alias("left2"))
    last = inside.join(second, F.col("source").eqNullSafe(F.col("s2")) & (fine == F.col("b2"))).withColumn("left", F.col("left2") - F.col("before2"))
    place = F.struct("rank", "doc_id", "size")
    run = F.sum("size").over(W.partitionBy("source").orderBy("rank", "doc_id", "size").rangeBetween(W.unboundedPreceding, W.currentRow))
    # The first document that no longer fits; all before it are in. A source without one is taken in full.
    cuts = last.withColumn("run", run).filter(F.col("run") > F.col("left")).groupBy("source").agg(F.min(place).alias("cut"))
    chosen = ranked.alias("r").join(cuts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")), "left").select(
        "r.*", "cut", (F.col("rank").isNotNull() & (F.col("cut").isNull() | (place < F.col("cut")))).alias("in_run"))

    gaps = chosen.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * (F.col("whole") + F.col("in_run").cast("long")))).alias("gap"))
    open_rows = chosen.filter(F.col("rank").isNotNull() & ~F.col("in_run")).select("source", "rank", "doc_id", "size").alias("o").join(
        gaps.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.*", "gap")
    miss = F.abs(F.col("size") - F.col("gap"))
    extra = open_rows.filter(miss < F.col("gap")).groupBy("source").agg(F.min_by(place, F.struct(miss, place)).alias("extra"))
    done = chosen.alias("h").join(extra.alias("e"), F.col("h.source").eqNullSafe(F.col("e.source")), "left")
    copies = F.col("whole") + F.when(F.col("in_run") | F.coalesce(place == F.col("extra"), F.lit(False)), 1).otherwise(0)
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), F.col("h.source").alias("source"), copies.cast("long").alias("copies"))
