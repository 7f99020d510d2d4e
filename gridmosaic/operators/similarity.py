"""Table similarity by shingles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmosaic.functions.values import once
from gridmosaic.operators.ranking import HOT_GROUP_ROWS, position_in_group
from gridmosaic.operators.scoring import ngrams, word_tokens
from gridmosaic.session import reliable_checkpoint

RARE = 64  # right sets of a shingle that is met and counted
HEADS = 4  # hot lists of which the whole first piece may give a first match
GLUE = "\x01"
LARGE_TABLE = 1_000_000  # characters of a table whose shingles are told apart in one row
BUNDLES = 8  # rows that the shingles of a table are packed in


def _shingles(low: Column, tokens: Column) -> Column:
    """Shingles of a cell in lower case, repeats kept: word pairs of a cell of several
    words, else the cell itself."""
    several = F.trim(low, F.lit(" \t\n\r\f\v")).rlike(r"\s") & (F.size(tokens) > 1)
    return F.when(several, ngrams(tokens, 2, GLUE)).otherwise(F.array(low))


def shingle_rows(cells: DataFrame, keys: tuple[str, ...] = ("table_id",), col: str = "cell") -> DataFrame:
    """Shingles of every cell, repeats kept: word pairs of a cell of several
    words, else the cell itself, in lower case."""
    low = cells.select(*keys, F.lower(col).alias("__cell")).withColumn("__tokens", word_tokens(F.col("__cell")))
    return low.select(*keys, F.explode(_shingles(F.col("__cell"), F.col("__tokens"))).alias("shingle"))


def table_shingles(cells: DataFrame, keys: tuple[str, ...] = ("table_id",), col: str = "cell", large: int = LARGE_TABLE) -> DataFrame:
    """Distinct shingles of a table.

    The cells of a table meet in one row, as text, and its shingles are told
    apart there; shuffled one by one they are many times that text. Tables of
    more than ``large`` characters, counted first, go by the rows of their
    shingles, so no row grows without bound. Both ways give the same rows.
    """
    size = F.sum(F.coalesce(F.length(col), F.lit(0)).cast("bigint") + 1)
    hot = cells.groupBy(*keys).agg(size.alias("__size")).where(F.col("__size") > large).select(*[F.col(k).alias(f"__hot_{k}") for k in keys])
    if hot.isEmpty():
        return _packed_shingles(cells, keys, col)
    is_hot = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys])
    rows = shingle_rows(cells.join(hot, is_hot, "left_semi"), keys, col).distinct()
    return _packed_shingles(cells.join(hot, is_hot, "left_anti"), keys, col).unionByName(rows)


def _packed_shingles(cells: DataFrame, keys: tuple[str, ...], col: str) -> DataFrame:
    """Distinct shingles of tables whose cells fit in one row; a missing cell is a shingle too."""
    met = cells.groupBy(*keys).agg(F.collect_list(F.struct(F.lower(col).alias("cell"))).alias("__cells"))
    found = F.transform("__cells", lambda c: once(word_tokens(c["cell"]), lambda tokens: _shingles(c["cell"], tokens)))
    return met.select(*keys, F.explode(F.array_distinct(F.flatten(found))).alias("shingle"))


def signatures(shingles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size and a 128-bit order-free fingerprint of each shingle set."""
    return shingles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("shingle")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(1), "shingle")).alias("h2"),
    )


def _side(shingles: DataFrame, block: Sequence[str], name: str, size: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (every table with its set), the sets with their size, and their shingles.

    One set per distinct content of a block; it goes by the smallest id of its tables.
    """
    members = reliable_checkpoint(signatures(shingles, [*block, "table_id"]))
    content = [*block, "n", "h1", "h2"]
    firsts = members.groupBy(*content).agg(F.min("table_id").alias(name))
    sets = reliable_checkpoint(firsts.select(*block, name, F.col("n").alias(size)))
    rows = shingles.withColumnRenamed("table_id", name).join(sets, [*block, name])
    return members.join(firsts, content, "left").select(*block, "table_id", name), sets, rows


def _bound(left: Column, n: Column, m: Column) -> Column:
    """The highest Jaccard of sets of n and m that have at most ``left`` in common."""
    both = F.least(left, m)
    return both.cast("double") / (n + m - both)


def _postings(right: DataFrame, frequency: DataFrame, block: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The list of every shingle by falling weight (smaller sets first, then smaller ids), cut into pieces, and what bounds a piece.

    A list of f has about sqrt(f) pieces of about sqrt(f), so neither a look at
    all bounds of a list nor one piece is long.
    """
    key = [*block, "shingle"]
    ordered = position_in_group(
        right, key, [F.col("right_n"), F.col("match_id")], F.col("right_n"), "at",
        hot_groups=frequency.where(F.col("frequency") > HOT_GROUP_ROWS).select(*key),
    )
    piece = F.floor((F.col("at") - 1) / F.ceil(F.sqrt("frequency"))).cast("int").alias("piece")
    postings = reliable_checkpoint(ordered.select(*key, piece, "right_n", "match_id"))
    pieces = postings.groupBy(*key, "piece").agg(
        F.min("right_n").alias("least_n"), F.max("right_n").alias("most_n"), F.min("match_id").alias("least_id"))
    return postings, pieces


def _similarities(pairs: DataFrame, left_hot: DataFrame, right_hot: DataFrame, block: Sequence[str]) -> DataFrame:
    """``similarity`` of pairs whose common rare shingles are counted in ``both``, with their common hot ones."""
    key = [*block, "left_set"]
    columns = [*key, "left_n", "right_n", "match_id", "both"]
    met = pairs.join(left_hot.select(*key, "shingle"), key).join(right_hot.select(*block, "match_id", "shingle"), [*block, "match_id", "shingle"])
    counted = pairs.select(*columns).unionByName(met.withColumn("both", F.lit(1).cast("bigint")).select(*columns)).groupBy(*columns[:-1]).agg(F.sum("both").alias("both"))
    return counted.where("both > 0").withColumn("similarity", _jaccard(F.col("both")))


def _jaccard(both: Column) -> Column:
    return both.cast("double") / (F.col("left_n") + F.col("right_n") - both)


def best_table_match(left: DataFrame, right: DataFrame, block_key: str | None = "block", least: float = 0.0, rare: int = RARE) -> DataFrame:
    """For each left table the most similar right table of its block.

    Inputs: (block, table_id, shingle), distinct; tables are listed in the order
    of their id, and ties go to the first. No overlap, or none of ``least``, gives null.

    Tables of equal content are compared once. Shingles of at most ``rare`` right
    sets are met and counted, so each gives so many rows at most. The common hot
    shingles of a pair are bounded by how many both have, and only pairs that can
    reach the best known match are looked up. A pair without a common rare
    shingle is found from the lists of the hot ones, read from rare to common: what is left
    of them bounds the overlap, so pieces of a list that cannot win are not opened.
    """
    block = [block_key] if block_key else []
    key = [*block, "left_set"]
    left, right = reliable_checkpoint(left), reliable_checkpoint(right)  # each is read several times
    left_members, left_sets, left_rows = _side(left, block, "left_set", "left_n")
    _, right_sets, right_rows = _side(right, block, "match_id", "right_n")
    frequency = reliable_checkpoint(right_rows.groupBy(*block, "shingle").agg(F.count(F.lit(1)).alias("frequency")))
    left_rows = reliable_checkpoint(left_rows.join(frequency, [*block, "shingle"]))
    hot = frequency.where(F.col("frequency") > rare)
    left_hot = left_rows.where(F.col("frequency") > rare)
    right_hot = reliable_checkpoint(right_rows.join(hot, [*block, "shingle"]))

    # the rows of pairs that meet are the most: they hold two ids, and get all else that is known of a set when counted
    met = left_rows.where(F.col("frequency") <= rare).select(*key, "shingle").join(right_rows.select(*block, "match_id", "shingle"), [*block, "shingle"])
    met = met.groupBy(*key, "match_id").agg(F.count(F.lit(1)).alias("both"))
    left_more = left_hot.groupBy(*key).agg(F.count(F.lit(1)).alias("left_more"))
    right_more = right_hot.groupBy(*block, "match_id").agg(F.count(F.lit(1)).alias("right_more"))
    more = F.coalesce(F.least(F.coalesce("left_more", F.lit(0)), F.coalesce("right_more", F.lit(0))), F.lit(0)).alias("more")
    columns = [*key, "left_n", "right_n", "match_id", "both"]
    left_known = left_sets.join(left_more, key, "left")
    right_known = right_sets.join(right_more, [*block, "match_id"], "left")
    met = reliable_checkpoint(met.join(left_known, key).join(right_known, [*block, "match_id"]).select(*columns, more))

    # a first match of each left set: of those met, or at the start of the hot lists, the one with most in common so far
    postings, pieces = _postings(right_hot, hot, block)
    place = F.row_number().over(W.partitionBy(*key).orderBy("frequency", "shingle"))
    left_hot = left_hot.withColumn("place", place)
    heads = postings.where("piece = 0")
    firsts = heads.groupBy(*block, "shingle").agg(F.min(F.struct("right_n", "match_id")).alias("f")).select(*block, "shingle", "f.*")
    begun = left_hot.where(F.col("place") <= HEADS).join(heads.drop("piece"), [*block, "shingle"]).unionByName(
        left_hot.where(F.col("place") > HEADS).join(firsts, [*block, "shingle"])).groupBy(*columns[:-1]).agg(F.lit(0).cast("bigint").alias("both"), F.count(F.lit(1)).alias("so_far"))
    started = met.select(*columns, F.col("both").alias("so_far")).unionByName(begun)
    best = F.max_by(F.struct(*columns[len(key):]), F.struct(_jaccard(F.col("so_far")), (-F.col("match_id")).alias("o"))).alias("s")
    seeds = _similarities(started.groupBy(*key).agg(best).select(*key, "s.*"), left_hot, right_hot, block)
    low = F.greatest("similarity", F.lit(float(least))).alias("low")
    seeds = reliable_checkpoint(seeds.select(*key, low, F.col("match_id").alias("seed_id")))

    def can_win(bound: Column, match_id: Column) -> Column:
        return (bound > F.col("low")) | ((bound == F.col("low")) & ((match_id <= F.col("seed_id")) | (F.col("low") == least)))

    most = F.least(F.col("both") + F.col("more"), F.col("left_n"), F.col("right_n"))
    open_met = met.join(seeds, key).where(can_win(_jaccard(most), F.col("match_id"))).select(*columns)
    reading = left_hot.join(left_more, key).join(seeds, key).withColumn("left", F.col("left_more") - F.col("place") + 1)
    # the bound rises with the size of a right set up to what is left, then falls
    top_n = F.greatest(F.col("least_n"), F.least(F.col("most_n"), F.col("left")))
    opened = reading.join(pieces, [*block, "shingle"]).where(can_win(_bound(F.col("left"), F.col("left_n"), top_n), F.col("least_id")))
    listed = opened.select(*key, "left_n", "left", "low", "seed_id", "shingle", "piece").join(postings, [*block, "shingle", "piece"])
    listed = listed.where(can_win(_bound(F.col("left"), F.col("left_n"), F.col("right_n")), F.col("match_id")))
    pairs = open_met.unionByName(listed.select(*columns[:-1]).distinct().withColumn("both", F.lit(0).cast("bigint")))
    pairs = reliable_checkpoint(pairs.groupBy(*columns[:-1]).agg(F.max("both").alias("both")))

    near = _similarities(pairs, left_hot, right_hot, block).where(F.col("similarity") >= least)
    best = near.groupBy(*key).agg(F.max(F.struct("similarity", (-F.col("match_id")).alias("o"))).alias("b"))
    found = best.select(*key, F.col("b.similarity").alias("similarity"), (-F.col("b.o")).alias("match_id"))
    return (
        left_members.join(found, key, "left")
        .select(*block, "table_id", "match_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    )


def near_duplicates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``best_table_match`` without a block: the most similar right table of at
    least ``threshold``, or null."""
    return best_table_match(left, right, None, threshold)


def multiset_jaccard(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sum of the smaller over sum of the larger shingle counts, 0 if empty.

    ``pairs``: left_id, right_id. Inputs: (table_id, shingle), repeats kept.
    """
    def bundles(rows: DataFrame, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("shingle"), F.lit(BUNDLES)).alias("part")
        packed = rows.groupBy("table_id", part).agg(F.sort_array(F.collect_list("shingle")).alias(name), F.count_if(F.col("shingle").isNull()).alias(f"{name}_missing"))
        return packed.withColumnRenamed("table_id", f"{name}_id")

    def split(name: str) -> tuple[Column, Column]:
        """Shingles in order without repeats, and the repeats."""
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(name, F.lit(1), F.greatest(F.size(name) - 1, F.lit(0))))
        placed = F.arrays_zip(F.col(name).alias("x"), before.alias("before"))
        more = F.transform(F.filter(placed, lambda p: p["x"] == p["before"]), lambda p: p["x"])
        return F.array_distinct(name).alias(name), more.alias(f"{name}_more")

    def entries(name: str, l: int, r: int) -> Column:
        both = F.filter(name, lambda x: F.array_contains("shared", x))
        return F.transform(both, lambda x: F.struct(x.alias("shingle"), F.lit(l).cast("bigint").alias("l"), F.lit(r).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("all")))

    # a table's shingles travel in a few rows, and equal shingles of a pair are in rows that meet
    key = ["left_id", "right_id"]
    none = F.array().cast("array<string>")
    parts = pairs.select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BUNDLES - 1).cast("bigint"))).alias("part"))
    met = parts.join(bundles(left, "left"), ["left_id", "part"], "left").join(bundles(right, "right"), ["right_id", "part"], "left")
    missing = [F.coalesce(f"{name}_missing", F.lit(0)).alias(f"{name}_missing") for name in ("left", "right")]
    rows = met.select(*key, "part", *[F.coalesce(name, none).alias(name) for name in ("left", "right")], *missing)
    rows = rows.withColumn("all", F.size("left") + F.size("right") + F.col("left_missing") + F.col("right_missing"))
    rows = rows.select(*key, "part", "all", F.least("left_missing", "right_missing").alias("missing"), *split("left"), *split("right"))
    # what two shingle sets have in common is counted at once; only shingles that both repeat are rows
    counted = rows.select(
        *key, "part", "all", (F.size(F.array_intersect("left", "right")) + F.col("missing")).alias("both"),
        F.array_intersect("left_more", "right_more").alias("shared"), "left_more", "right_more",
    )
    first = F.struct(F.lit(None).cast("string").alias("shingle"), F.col("both").alias("l"), F.col("both").alias("r"), F.col("all").alias("all"))
    listed = F.when(F.size("shared") > 0, F.concat(F.array(first), entries("left_more", 1, 0), entries("right_more", 0, 1))).otherwise(F.array(first))
    per_shingle = counted.select(*key, "part", F.explode(listed).alias("s")).select(*key, "part", "s.*").groupBy(*key, "part", "shingle").agg(
        F.sum("l").alias("l"), F.sum("r").alias("r"), F.sum("all").alias("all"))
    sums = per_shingle.groupBy(*key).agg(F.sum(F.least("l", "r")).alias("both"), F.sum("all").alias("all"))
    return pairs.join(sums, key, "left").select(
        *key, F.coalesce(F.try_divide(F.col("both").cast("double"), F.col("all") - F.col("both")), F.lit(0.0)).alias("similarity")
    )


def compare_matches(a: DataFrame, b: DataFrame, key: str = "table_id") -> DataFrame:
    """Tables compared, and those for which two strategies chose differently."""
    joined = a.select(key, F.col("match_id").alias("a")).join(b.select(key, F.col("match_id").alias("b")), key)
    return joined.agg(F.count(F.lit(1)).alias("tables"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"))
