"""Removal of lines by how often they stand on the pages of their site."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridmosaic.llm.common import stage


def site_lines(docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """Lines that stand on more than `max_ratio` of the pages of their host, and on `min_pages` of them at least.

    A line counts once per page (row); blank lines do not count. Pages are counted by a 64-bit hash of the line first, and only hashes
    above the ratio are counted again by the lines themselves, so the shuffle carries no line text but that of candidates, and equal hashes
    of different lines do no harm. Sums are combined before every shuffle, so a hot host or line has one row per task.
    A host has at most its mean lines per page / `max_ratio` such lines. A null host is a host.
    Returns host, line, pages, host_pages.
    """
    pages = docs.select(F.col(host).alias("host"), F.array_distinct(F.split(text, "\n")).alias("lines"))
    totals = docs.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_pages"))
    lines = pages.select("host", F.explode("lines").alias("line")).filter(F.length(F.trim("line")) > 0)
    frequent = (F.col("pages") > F.lit(max_ratio) * F.col("host_pages")) & (F.col("pages") >= min_pages)

    def above(counts: DataFrame) -> DataFrame:
        t = totals.withColumnRenamed("host", "th")
        return counts.filter(F.col("pages") >= min_pages).join(t, F.col("host").eqNullSafe(F.col("th"))).drop("th").filter(frequent)

    # Written, so that Spark knows the size before it plans the join: a small list goes to the tasks, and no line is shuffled.
    hashes = stage(above(lines.groupBy("host", F.xxhash64("line").alias("hash")).agg(F.count(F.lit(1)).alias("pages"))), "line-hashes")
    keys = hashes.select(F.col("host").alias("kh"), "hash")
    candidates = lines.join(keys, F.col("host").eqNullSafe(F.col("kh")) & (F.xxhash64("line") == F.col("hash")), "left_semi")
    return above(candidates.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")))


def drop_site_lines(docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """Documents without the boilerplate lines of their site.

    All copies of a boilerplate line go, the other lines keep their order and blanks. The lines of one host are gathered as one array
    (bounded, see `site_lines`) and met with each page's lines by hash. Null text stays null with 0 lines; an empty text has one
    blank line. Rows repeat as often as they came. Columns called n_lines or n_dropped are replaced, all others are kept.
    Returns docs with `text` rewritten, n_lines, n_dropped.
    """
    bad = site_lines(docs, text, host, max_ratio, min_pages).groupBy("host").agg(F.collect_set("line").alias("__bad"))
    bad = stage(bad, "site-lines").withColumnRenamed("host", "__host")
    docs = docs.drop("n_lines", "n_dropped", "__bad", "__host")
    joined = docs.join(bad, docs[host].eqNullSafe(F.col("__host")), "left")
    lines = F.split(text, "\n")
    hit = F.when(F.col("__bad").isNotNull() & F.arrays_overlap(lines, "__bad"), F.array_intersect(lines, F.col("__bad")))
    joined = joined.withColumn("__hit", hit)
    kept = F.when(F.col("__hit").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("__hit"), x)))
    joined = joined.withColumn("__kept", kept)
    count = F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0))
    left = F.coalesce(F.when(F.col(text).isNotNull(), F.size("__kept")), F.lit(0))
    return joined.withColumn("n_lines", count.cast("long")).withColumn("n_dropped", (count - left).cast("long")).withColumn(
        text, F.when(F.col("__hit").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n"))).drop("__bad", "__host", "__hit", "__kept")
