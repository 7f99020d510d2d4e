"""URL filters whose lists change over time: an as-of join of captures with dated list entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def host_of(url: Column) -> Column:
    """The lower-case host, without user, port and last dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def address_of(url: Column) -> Column:
    """Host and path as written, without scheme, user, port, query and fragment; null without a host."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), path)


def capture_keys(url: Column, max_labels: int) -> Column:
    """What list entries of at most `max_labels` labels can name of an address: the domains its host lies in, and its address."""
    parts = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - max(max_labels, 1) + 1), F.size(parts)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    address = F.array(F.concat(F.lit("address:"), address_of(url)))
    return F.concat(domains, address)


def _bucket(at: Column, days: int) -> Column:
    return F.floor(F.unix_seconds(at.cast("timestamp")) / (86400 * days)).cast("long")


def _start(bucket: Column, days: int) -> Column:
    return F.timestamp_seconds(bucket * (86400 * days))


def validity(log: DataFrame, first_bucket: int, last_bucket: int, bucket_days: int) -> DataFrame:
    """Intervals in which the entries of a log are on their lists, cut at bucket borders.

    `log` has list, key, at, added. An entry holds from an addition up to the next removal; of changes at one time
    the addition is the last. Changes are ordered inside (list, key, bucket); what holds at the end of a bucket is carried over the
    buckets to the next change, so a key with many changes is split by time. Changes after the last capture count for nothing.
    Returns list, key, bucket, since, until (not included).
    """
    log = log.filter(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("added").isNotNull()).select(
        "list", "key", F.col("at").cast("timestamp").alias("at"), "added").distinct()
    log = log.withColumn("bucket", F.least(_bucket(F.col("at"), bucket_days), F.lit(last_bucket + 1)))
    log = log.filter(F.col("bucket") <= last_bucket)
    inside = W.partitionBy("list", "key", "bucket").orderBy("at", "added")
    own = log.withColumn("until", F.coalesce(F.lead("at").over(inside), _start(F.col("bucket") + 1, bucket_days))).filter("added")
    own = own.select("list", "key", "bucket", F.col("at").alias("since"), "until")
    ends = log.groupBy("list", "key", "bucket").agg(F.max_by("added", F.struct("at", "added")).alias("added"), F.min("at").alias("first_at"))
    order = W.partitionBy("list", "key").orderBy("bucket")
    ends = ends.withColumn("next", F.lead("bucket").over(order)).withColumn("next_at", F.lead("first_at").over(order)).filter("added")
    from_bucket = F.greatest(F.col("bucket") + 1, F.lit(first_bucket))
    to_bucket = F.coalesce("next", F.lit(last_bucket))
    carried = ends.filter(from_bucket <= to_bucket).select("list", "key", "next", "next_at", F.explode(F.sequence(from_bucket, to_bucket)).alias("bucket"))
    carried = carried.select("list", "key", "bucket", _start(F.col("bucket"), bucket_days).alias("since"),
                             F.when(F.col("bucket") == F.col("next"), F.col("next_at")).otherwise(_start(F.col("bucket") + 1, bucket_days)).alias("until"))
    return own.unionByName(carried).filter(F.col("since") < F.col("until"))


def filter_captures(captures: DataFrame, log: DataFrame, bucket_days: int = 7) -> DataFrame:
    """The verdict on every capture by the list entries active when it was fetched.

    `captures` has page_id, url, fetched_at; `log` has list ('block' or 'allow'), key ('domain:...' or 'address:...'), at, added.
    A capture is rejected if an active block entry names its address or a domain of its host, and no active allow entry does. Each
    distinct (url, fetched_at) is judged once, joined on key and time bucket, so a hot host is spread over the buckets,
    and a capture meets only the few intervals of its key and bucket. Hosts of any length are looked up under all their domains.

    Null url or fetch time, or a url without host: no entry applies, kept. Repeated captures repeat. Other columns are dropped.
    Returns page_id, url, fetched_at, n_block, n_allow, entry (the first active entry that decides, else null), kept.
    """
    captures = captures.select("page_id", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    # No domain with more labels than the longest entry can be listed, so a host of any length gives few keys and misses none.
    longest = log.agg(F.max(F.when(F.col("key").startswith("domain:"), F.size(F.split("key", r"\."))))).first()[0] or 1
    span = captures.agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b")).select(_bucket(F.col("a"), bucket_days), _bucket(F.col("b"), bucket_days)).first()
    first_bucket, last_bucket = (span[0], span[1]) if span[0] is not None else (0, 0)
    intervals = validity(log, first_bucket, last_bucket, bucket_days)
    distinct = captures.filter(F.col("url").isNotNull() & F.col("fetched_at").isNotNull()).select("url", "fetched_at").distinct()
    keys = distinct.select("url", "fetched_at", _bucket(F.col("fetched_at"), bucket_days).alias("bucket"), F.explode(F.array_distinct(capture_keys(F.col("url"), longest))).alias("key"))
    active = keys.join(intervals, ["key", "bucket"]).filter((F.col("since") <= F.col("fetched_at")) & (F.col("fetched_at") < F.col("until")))
    blocks, allows = F.col("list") == "block", F.col("list") == "allow"
    found = active.groupBy(F.col("url").alias("u"), F.col("fetched_at").alias("f")).agg(
        F.count_if(blocks).alias("n_block"), F.count_if(allows).alias("n_allow"),
        F.min(F.when(blocks, F.col("key"))).alias("block_entry"), F.min(F.when(allows, F.col("key"))).alias("allow_entry"))
    joined = captures.join(found, (F.col("url") == F.col("u")) & (F.col("fetched_at") == F.col("f")), "left")
    n_block, n_allow = F.coalesce("n_block", F.lit(0)).cast("long"), F.coalesce("n_allow", F.lit(0)).cast("long")
    return joined.select(
        "page_id", "url", "fetched_at", n_block.alias("n_block"), n_allow.alias("n_allow"),
        F.coalesce("allow_entry", "block_entry").alias("entry"), ((n_block == 0) | (n_allow > 0)).alias("kept"))
