"""Benchmark passages in training text, by a positional inverted index."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmosaic.llm.common import stage

WINDOW = 13
TERM = 3  # words of an index term, fewer for shorter items
# Runs of digits, letters and characters beyond ASCII; A-Z are lowered word by word.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """The words of a text as they stand; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z in lower case, nothing else changed. A word with a byte per character is ASCII, for which `lower` does just that."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def grams(words: Column, n: int) -> Column:
    """Hashes of the runs of n words, by place."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(F.lit(n), *[F.get(words, i + k) for k in range(n)])))


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with two keys that identify id and text: rows equal in both have equal results."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct items with words: item (id as text, empty for null), words, span (words of a window), n (words of a term)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.transform(tokens(F.col("text")), lowered).alias("words")).distinct()
    return items.filter(F.size("words") > 0).withColumn("span", F.least(F.lit(WINDOW), F.size("words"))).withColumn("n", F.least(F.lit(TERM), F.size("words")))


def item_terms(items: DataFrame) -> DataFrame:
    """The terms of items by place: item, words, span, n, at, term."""
    listed = F.lit(None).cast("array<bigint>")
    for n in range(1, TERM + 1):
        listed = F.when(F.col("n") == n, grams(F.col("words"), n)).otherwise(listed)
    return items.select("item", "words", "span", "n", F.posexplode(listed).alias("at", "term"))


def postings(docs: DataFrame, vocabulary: DataFrame, lengths: list[int]) -> DataFrame:
    """The index: one row (term, k1, k2, pos) per place of a document at which a term of the vocabulary starts.

    A term is a run of 1 to 3 words, `lengths` those of the vocabulary, as a 64-bit hash: equal hashes can only add
    candidates, which are compared word by word at the end.
    """
    words = docs.select("k1", "k2", F.transform(tokens(F.col("text")), lowered).alias("words"))
    out = None
    for n in lengths:
        terms = words.select("k1", "k2", F.posexplode(grams(F.col("words"), n)).alias("pos", "term")).join(vocabulary, "term").select("term", "k1", "k2", "pos")
        out = terms if out is None else out.unionByName(terms)
    return out


def phrase_candidates(index: DataFrame, items: DataFrame) -> DataFrame:
    """Places where an item may lie in a document: (k1, k2, item, words, span, shift), item word i at document word i + shift.

    Each window is looked up by its terms from the rarest in the corpus on: the list of the rarest gives the shifts, and the lists of the next
    two, moved by their places in the item, must have them as well. A window with a term that no document has is dropped.
    Windows of an item with the same rarest places are looked up once.
    """
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    places = item_terms(items).join(counts, "term", "left")
    listed = places.groupBy("item", "words", "span", "n").agg(F.array_sort(F.collect_list(F.struct("at", "count", "term"))).alias("p"))
    inside = F.col("span") - F.col("n") + 1  # terms of a window
    windows = listed.select("item", "words", "span", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("span") + 1), lambda s: F.slice("p", s, inside))).alias("w"))
    windows = windows.filter(F.forall("w", lambda x: x["count"].isNotNull()))
    rarest = F.array_sort(F.transform("w", lambda x: F.struct(x["count"].alias("count"), x["at"].alias("at"), x["term"].alias("term"))))
    looked = windows.select("item", "words", "span", F.slice(rarest, 1, 3).alias("r")).distinct()
    # Written, so that Spark knows the size before it plans the joins.
    looked = stage(looked.select("item", "words", "span", *[F.get("r", F.lit(k))[f].alias(f"{f}{k}") for k in range(3) for f in ("at", "term")]), "looked-up")

    found = looked.join(index.withColumnRenamed("term", "term0"), "term0").withColumn("shift", F.col("pos") - F.col("at0")).drop("pos", "term0", "at0")
    for k in (1, 2):
        terms = looked.select(F.col(f"term{k}").alias("term")).filter(F.col("term").isNotNull()).distinct()
        other = index.join(terms, "term", "left_semi").select(F.col("term").alias(f"term{k}"), "k1", "k2", F.col("pos").alias(f"pos{k}"))
        there = found.filter(F.col(f"term{k}").isNotNull()).withColumn(f"pos{k}", F.col("shift") + F.col(f"at{k}")).join(other, [f"term{k}", "k1", "k2", f"pos{k}"], "left_semi")
        short = found.filter(F.col(f"term{k}").isNull()).withColumn(f"pos{k}", F.lit(None).cast("int"))
        found = there.unionByName(short).drop(f"pos{k}", f"term{k}", f"at{k}")
    return found.select("k1", "k2", "item", "words", "span", "shift").distinct()


def hits(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Hit words and items of documents with candidates: (k1, k2, n_hit, items), compared word by word."""
    gathered = candidates.groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "words", "span", "shift")).alias("c"))
    texts = docs.select("k1", "k2", "text").join(gathered, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    read = texts.select("k1", "k2", "c", F.transform(tokens(F.col("text")), lowered).alias("d"))
    rows = read.select("k1", "k2", "d", F.explode("c").alias("c"))
    same = F.transform(F.col("c.words"), lambda w, i: F.coalesce(F.get("d", i + F.col("c.shift")) == w, F.lit(False)))
    rows = rows.select("k1", "k2", "c.item", "c.span", "c.shift", same.alias("same"))
    starts = F.filter(F.sequence(F.lit(0), F.size("same") - F.col("span")), lambda s: F.forall(F.slice("same", s + 1, F.col("span")), lambda x: x))
    rows = rows.withColumn("starts", starts).filter(F.size("starts") > 0)
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(F.col("shift") + s, F.col("shift") + s + F.col("span") - 1))))
    rows = rows.select("k1", "k2", "item", covered.alias("covered"))
    return rows.groupBy("k1", "k2").agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, min_share: int = 20) -> DataFrame:
    """How far each document consists of benchmark passages.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lowered. A window is 13 words of an item in a row, or all words of a shorter one;
    a document word inside an occurrence of a window is hit. Contaminated: `min_share` times the hit words are at least all words, and some word is hit.

    The index holds the postings of every document for the terms of the benchmark, runs of three words, and is written once, in the order of
    the documents, without a shuffle. Posting lists are joined, never gathered. Null text: no words. An item without words has no window; an item id
    that stands on several rows is one item, a null id is the item ''. Rows equal in id and text have equal results. Other columns are dropped.
    Returns doc_id, text, n_words, n_hit, n_items, items_sha256, contaminated.
    """
    docs = keyed(docs)
    found = matched(docs, benchmark)
    counted = docs.select("doc_id", "text", "k1", "k2", F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_words"))
    joined = counted.join(found, ["k1", "k2"], "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "text", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), ((n_hit > 0) & (F.lit(min_share) * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_share: int = 20) -> DataFrame:
    """Documents that are not contaminated, with all their columns. Cases as in `find_contamination`."""
    docs = docs.withColumns({"__k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__k2": F.xxhash64("text")})
    keys = keyed(docs)
    found = matched(keys, benchmark)
    sizes = keys.select("k1", "k2", F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_words")).join(found, ["k1", "k2"]).distinct()
    bad = stage(sizes.filter(F.lit(min_share) * F.col("n_hit") >= F.col("n_words")).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), "contaminated")
    return docs.join(bad, ["__k1", "__k2"], "left_anti").drop("__k1", "__k2")


def matched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hit words and items of the documents (`keyed`) that have some: (k1, k2, n_hit, items)."""
    items = stage(items_of(benchmark), "items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect()) or [TERM]  # three at most
    vocabulary = stage(item_terms(items).select("term").distinct(), "vocabulary")
    index = stage(postings(docs, vocabulary, lengths), "postings")
    return stage(hits(docs, stage(phrase_candidates(index, items), "phrase-candidates")), "hits")


def proximity_matches(docs: DataFrame, words: list[str], within: int) -> DataFrame:
    """Documents (`keyed`) in which all words stand within `within` positions: (k1, k2, start), start being a place of the rarest word.

    Each list is met with that of the rarest by document and a block of positions, so a common word adds no pairs beyond its near places.
    """
    wanted = docs.sparkSession.createDataFrame([([w],) for w in dict.fromkeys(words)], "words array<string>").select(grams(F.col("words"), 1)[0].alias("term"))
    index = stage(postings(docs, wanted, [1]), "word-postings")
    counts = {r["term"]: r["count"] for r in index.join(wanted, "term").groupBy("term").count().collect()}  # one row per given word
    terms = [r["term"] for r in wanted.collect()]
    if any(t not in counts for t in terms):
        return index.select("k1", "k2", F.col("pos").alias("start")).limit(0)
    terms.sort(key=lambda t: counts[t])
    found = index.filter(F.col("term") == terms[0]).select("k1", "k2", F.col("pos").alias("start"))
    for t in terms[1:]:
        near = index.filter(F.col("term") == t).select("k1", "k2", "pos", F.explode(F.array(*[F.floor(F.col("pos") / within) + d for d in (-1, 0, 1)])).alias("block"))
        found = found.withColumn("block", F.floor(F.col("start") / within)).join(near, ["k1", "k2", "block"]).filter(F.abs(F.col("pos") - F.col("start")) <= within)
        found = found.select("k1", "k2", "start").distinct()
    return found
