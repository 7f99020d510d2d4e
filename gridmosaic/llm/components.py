"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridmosaic.llm.common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of a node move to the smallest of them, the larger ones (large) or the others."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    if large:
        moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(u, root) for every node of `edges` (u, v) that is not the smallest of its component.

    Large and small star steps by turns; every neighbourhood is a minimum and a join, never gathered. Ends when a round changes nothing.
    """
    edges = stage(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        edges = stage(_star(_star(edges, True), False), "edges")
        # Equal count and sum of hashes in two rounds running: the edges are the same.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
