"""N-gram Jaccard join by a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gridmosaic.llm.common import TEXT_ROWS, stage
from gridmosaic.llm.components import components
from gridmosaic.llm.hashing import FILTER_BITS, joint, key_filter, mix, passes_filter, slices, word_hashes

N_WORDS = 5
N_KEYS = 3  # grouping keys of a set
ROUNDS = 2  # of heads per key
HEAD_ROUNDS = 2  # of heads per token
QUERY_ROUNDS = 3  # of counting the tokens that stand in other groups
IMAGE_BITS = 1024  # of the bit image of a set
CHUNK_TOKENS = 1 << 18  # prefix tokens met before they leave a task
TEXT_BYTES = 1 << 17  # of texts hashed at a time; each becomes a dozen numbers for a while

PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingles_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts that lie one after another in `raw`: (text number, hash), sorted by both.

    A-Z are lowered. A shingle's hash is a weighted sum of its words' hashes, scrambled. A text of one to four words has one shingle of all of them.
    """
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if not len(raw):
        return none
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    word = ~blank
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1
    if not len(starts):
        return none
    words = word_hashes(low, starts, ends)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    n = np.bincount(owner, minlength=len(bounds) - 1)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    at = np.arange(len(words))
    full = at + N_WORDS - 1 < (first + n)[owner]
    s = at[full]
    hashes = sum((words[s + k] * PLACES[k] for k in range(N_WORDS)), np.zeros(len(s), dtype=np.uint64))
    texts = owner[s]
    short = np.flatnonzero((n > 0) & (n < N_WORDS))
    if len(short):
        whole = n[short].astype(np.uint64)
        for k in range(N_WORDS - 1):
            there = n[short] > k
            whole[there] += words[first[short[there]] + k] * PLACES[k]
        texts, hashes = np.append(texts, short), np.append(hashes, whole)
    hashes = mix(hashes, 1)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(texts[order], kind="stable")]
    texts, hashes = texts[order], hashes[order]
    new = np.ones(len(texts), dtype=bool)
    new[1:] = (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])
    return texts[new], hashes[new]


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first row, rows, sizes, both halves of the set prints, places and hashes of the sets' members."""
    for first, raw, bounds in slices(batch, TEXT_BYTES):
        rows = len(bounds) - 1
        texts, hashes = shingles_of(raw, bounds)
        n = np.bincount(texts, minlength=rows)
        at = np.concatenate([[0], np.cumsum(n)])
        prints = []
        for seed in (2, 3):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes, seed))])
            prints.append(mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64), seed).view(np.int64))
        yield first, rows, n, np.stack(prints), at, hashes


def spare(n):
    """How many shingles of a set of n a similar set may lack."""
    return n // 5


def prefix_length(n):
    """Shingles of a set that are compared first: those that may be lacked and a tenth."""
    return np.minimum(n, spare(n) + (n + 9) // 10)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n and the two prints of the set."""
    for batch in batches:
        for first, rows, n, prints, _, _ in _sets(batch):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), pa.array(n.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1])], names=["doc_id", "n", "a", "b"])


def meet_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix tokens (the smallest hashes) of the distinct sets of a chunk, combined before they leave the task.

    A token of one set leaves as (token, a). A token of two sets or more is known to be shared: the sets
    count it here, and it leaves once, with c = -1. Each set sends its count c with its size n, under its own print as token.
    So a token has one row per chunk, however frequent it is.
    """
    chunk, held = 0, 0
    parts: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        a, n, t, length = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        owner = np.repeat(np.arange(len(a)), length)
        _, one = np.unique(a, return_index=True)
        single = np.zeros(len(a), dtype=bool)
        single[one] = True
        t, owner = t[single[owner]], owner[single[owner]]
        order = np.argsort(t, kind="stable")
        t, owner = t[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(start, len(t)))
        local = np.bincount(owner[np.repeat(count > 1, count)], minlength=len(a))[one]
        alone, met = start[count == 1], start[count > 1]
        columns = (
            np.concatenate([t[alone], t[met], a[one]]), np.concatenate([a[owner[alone]], np.zeros(len(met), np.int64), a[one]]),
            np.concatenate([np.zeros(len(alone), np.int32), np.full(len(met), -1, np.int32), local.astype(np.int32)]),
            np.concatenate([np.zeros(len(alone) + len(met), np.int32), n[one].astype(np.int32)]))
        out = [pa.array(x) for x in columns] + [pa.array(np.full(len(columns[0]), chunk, np.int32))]
        return pa.RecordBatch.from_arrays(out, names=["token", "a", "c", "n", "chunk"])

    for batch in batches:
        for _, _, n, prints, at, hashes in _sets(batch):
            full = n > 0
            size = prefix_length(n)[full]
            ends = np.cumsum(size)
            keep = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[:-1][full] - ends + size, size)
            parts.append((prints[0][full], n[full], hashes[keep].view(np.int64), size))
            held += len(keep)
            if held >= CHUNK_TOKENS:
                yield flush()
                chunk, held = chunk + 1, 0
    if parts:
        yield flush()


def bit_image(hashes: np.ndarray) -> np.ndarray:
    """A bit per residue that some member has, as 64-bit words. A bit that another set's image lacks stands for a member that the other set lacks."""
    bits = np.zeros(IMAGE_BITS, dtype=bool)
    bits[(hashes >> np.uint64(20)) % np.uint64(IMAGE_BITS)] = True
    return np.packbits(bits).view(np.int64)


def lacking(image: Column, other: Column) -> Column:
    """How many members of a set the other lacks, at least."""
    words = [F.bit_count(F.get(image, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(k))))) for k in range(IMAGE_BITS // 64)]
    return sum(words[1:], words[0])


def full_sets(known: np.ndarray, bits: int):
    """A task that hashes texts again and gives the whole sets of those that pass the filter of (doc_id, prints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()  # a repeated row is given once per task
        for batch in batches:
            for first, rows, n, prints, at, hashes in _sets(batch):
                ids = batch.column("doc_id").slice(first, rows).fill_null(-(1 << 63)).to_numpy()
                chosen = np.flatnonzero((n > 0) & passes_filter(known, joint(ids, prints[0], prints[1]), bits))
                chosen = np.array([i for i in chosen if (a := int(prints[0][i])) not in given and not given.add(a)], dtype=np.int64)
                if not len(chosen):
                    continue
                lists = [hashes[at[i]: at[i + 1]] for i in chosen]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                keys = np.array([[int(mix(x, 20 + k).min()) if k else int(x[0]) for k in range(N_KEYS)] for x in lists], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(n[chosen].astype(np.int64)), pa.array(prints[0][chosen]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(chosen) + 1, dtype=np.int32) * N_KEYS), pa.array(keys.ravel())),
                    pa.array([bit_image(x) for x in lists], pa.list_(pa.int64())),
                ], names=["n", "a", "hashes", "keys", "image"])

    return run


def similar(inter: Column, n1: Column, n2: Column) -> Column:
    return 100 * inter >= 80 * (n1 + n2 - inter)


def star_links(sets: DataFrame, private: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Links (u, v) from each set to the head of each of its key groups, where they are similar.

    `private` gives for each set how many of its prefix tokens no other set has. The head of a group is the set with the fewest: what copies
    were made from has none, while a copy has those of its changes, so copies that are not similar to each other still meet in
    their source. Sets without a link form groups with a new head in the next round. Every set is compared with one other per key and round,
    and only once if keys agree on it, so a group of any size costs its length.
    """
    slim = sets.select("a", "n", "keys").join(private, "a", "left").withColumn("private", F.coalesce("private", "n"))
    keyed = stage(slim.select("a", "n", "private", F.posexplode("keys").alias("k", "key")), "set-keys")
    out = None
    for _ in range(rounds):
        heads = keyed.groupBy("k", "key").agg(F.min(F.struct("private", "a", "n")).alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        pairs = keyed.join(heads, ["k", "key"]).select(F.col("a").alias("u"), "n", F.col("head.a").alias("v"), F.col("head.n").alias("vn"))
        pairs = pairs.filter((F.col("u") != F.col("v")) & (5 * F.col("n") >= 4 * F.col("vn")) & (5 * F.col("vn") >= 4 * F.col("n"))).select("u", "v").distinct()
        linked = stage(_similar_pairs(pairs, sets), "star-links")
        out = linked if out is None else out.unionByName(linked)
        met = linked.select(F.col("u").alias("a")).unionByName(linked.select(F.col("v").alias("a"))).distinct()
        keyed = stage(keyed.join(met, "a", "left_anti"), "set-keys")
    return out


def _similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("a").alias("u"), F.col("n").alias("un"), F.col("hashes").alias("uh"))
    right = sets.select(F.col("a").alias("v"), F.col("n").alias("vn"), F.col("hashes").alias("vh"))
    met = stage(pairs, "pairs").join(left, "u").join(right, "v")
    return met.filter(similar(F.size(F.array_intersect("uh", "vh")), F.col("un"), F.col("vn"))).select("u", "v").distinct()


def _shared(tokens: DataFrame) -> DataFrame:
    """Rows (a, n, grp, token) whose token stands in two groups or more."""
    shared = tokens.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi").select("token")
    return tokens.join(stage(shared, "shared-tokens"), "token")


def needed_in_prefix(n: Column) -> Column:
    """Prefix tokens that a set of n has in common with any similar one, at least."""
    return F.floor((n - F.floor(n / 5) + 9) / 10)


def _reach(left: Column, other: Column, n: Column, other_n: Column) -> Column:
    """The overlap, at most what is left in both orders from the first common token on, can be four ninths of both sizes: a similarity of 0.8."""
    return 9 * F.least(left, other) >= 4 * (n + other_n)


def _near() -> Column:
    """Whether the bounds of a and d, which have a token in common, let them be similar."""
    n, dn = F.col("n"), F.col("dn")
    near = _reach(F.col("left"), F.col("dleft"), n, dn) & (5 * n >= 4 * dn) & (5 * dn >= 4 * n)
    # nor can more be common than what both hold of each other's bits
    return near & _reach(n - lacking(F.col("image"), F.col("dimage")), dn - lacking(F.col("dimage"), F.col("image")), n, dn)


def join_groups(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, hub): the linked group that each group with links goes to, of it and its neighbours the one with the most neighbours.

    `links` (u, v) lie between sets, `groups` gives (a, grp) of them. Groups that go to one hub are all linked with it, so they are of one component;
    a hub that goes to another one itself is not followed, which leaves groups apart that could be one.
    """
    ends = links.join(groups.select(F.col("a").alias("u"), F.col("grp").alias("g")), "u").join(groups.select(F.col("a").alias("v"), F.col("grp").alias("h")), "v")
    both = ends.select("g", "h").unionByName(ends.select(F.col("h").alias("g"), F.col("g").alias("h"))).filter(F.col("g") != F.col("h")).distinct()
    degrees = both.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    around = both.join(degrees.select(F.col("g").alias("h"), "c"), "h").groupBy("g").agg(F.max(F.struct("c", "h")).alias("most"))
    own = around.join(degrees, "g")
    return own.select("g", F.greatest(F.col("most"), F.struct("c", F.col("g").alias("h")))["h"].alias("hub"))


def links_between_groups(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between sets of different groups that join all groups with similar sets, by the token-group matrix.

    `groups` has (u, root) of sets that are not their own root. The matrix holds (token, group): the union of the members' tokens. A set can be similar
    to one of another group only if that group's union holds at least four fifths of its tokens. First each set counts its tokens that stand in any
    other group, at first in its prefix only (see `near_duplicates`); most sets end there. The rest look up the groups of their rarest tokens, as many as they may lack and one. What follows such a token in the
    order of both bounds the overlap, and only groups whose bound reaches four fifths are opened. Only members that
    passed the first count can be partners, and a pair is compared if its own bound does and the bit images of both sets allow it.
    Before groups are opened, each set is compared with one member of the largest group of each of its rarest tokens, and groups linked
    by that are one group from then on (`join_groups`): near copies that missed each other's heads need not meet pair by pair.
    """
    placed = sets.join(groups, sets["a"] == groups["u"], "left").select("a", "n", F.coalesce("root", "a").alias("grp"))
    placed = stage(placed, "placed-sets")
    size = F.least(F.col("n"), F.floor(F.col("n") / 5) + F.floor((F.col("n") + 9) / 10)).cast("int")
    prefixes = sets.select("a", F.slice("hashes", F.lit(1), size).alias("h")).join(placed, "a").select("a", "n", "grp", F.explode("h").alias("token"))
    open_sets = _shared(prefixes).groupBy("a", "n", "grp").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= needed_in_prefix(F.col("n"))).select("a", "n", "grp")
    open_sets = stage(open_sets, "open-sets")
    tokens = sets.select("a", "hashes").join(open_sets, "a").select("a", "n", "grp", F.explode("hashes").alias("token"))
    outside = stage(_shared(tokens), "outside-tokens")
    least = F.col("n") - F.floor(F.col("n") / 5)
    queries = None
    for _ in range(QUERY_ROUNDS):  # partners are queries themselves, so only their tokens count the next time
        outside = outside if queries is None else stage(_shared(outside.join(queries.select("a"), "a", "left_semi")), "outside-tokens")
        queries = outside.groupBy("a", "n", "grp").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= least)
        queries = stage(queries.withColumn("least", least), "group-queries")
    if queries.isEmpty():
        return queries.select(F.col("a").alias("u"), F.col("a").alias("v")).limit(0)
    asked = stage(outside.join(queries.select("a", "m", "least"), "a"), "asked-tokens")
    weights = asked.select("token", "grp").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("gf"))
    ranked = asked.join(weights, "token").groupBy("a", "n", "grp", "m", "least").agg(F.array_sort(F.collect_list(F.struct("gf", "token"))).alias("t"))
    first = F.col("m") - F.col("least") + 1  # one of so many rarest tokens is common to any similar set
    rows = ranked.select("a", "n", "grp", "m", F.posexplode(F.slice("t", 1, first.cast("int"))).alias("at", "t"))
    images = sets.join(queries.select("a"), "a", "left_semi").groupBy("a").agg(F.first("image").alias("image"))
    prefix = stage(rows.select("a", "n", "grp", (F.col("m") - F.col("at")).alias("left"), "t.token").join(images, "a"), "group-prefixes")

    known = stage(images.join(queries.select("a", "n"), "a").select(F.col("a").alias("d"), F.col("n").alias("dn"), F.col("image").alias("dimage")), "head-images")
    out = None
    for _ in range(HEAD_ROUNDS):
        heads = prefix.groupBy("token", "grp").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("left", "a")).alias("h"))
        heads = heads.groupBy(F.col("token").alias("t")).agg(F.max(F.struct("c", "h", "grp")).alias("m"))
        heads = heads.select("t", F.col("m.h.left").alias("dleft"), F.col("m.h.a").alias("d"), F.col("m.grp").alias("dgrp")).join(known, "d")
        tried = prefix.join(heads, (F.col("token") == F.col("t")) & (F.col("grp") != F.col("dgrp")) & _near())
        linked = stage(_similar_pairs(tried.select(F.least("a", "d").alias("u"), F.greatest("a", "d").alias("v")).distinct(), sets), "head-links")
        out = linked if out is None else out.unionByName(linked)
        joined = join_groups(linked, prefix.select("a", "grp").distinct())
        moved = prefix.join(joined.withColumnRenamed("g", "grp"), "grp", "left").withColumn("grp", F.coalesce("hub", "grp")).drop("hub")
        prefix = stage(_shared(moved), "group-prefixes")

    # The matrix: the union of the members' rarest tokens, with the most that is left of any member, the span of their sizes and the image of all their tokens.
    union = F.array(*[F.bit_or(F.get("image", F.lit(k))) for k in range(IMAGE_BITS // 64)]).alias("union")
    matrix = prefix.groupBy(F.col("token").alias("t"), F.col("grp").alias("other")).agg(
        F.max("left").alias("most_left"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), union)
    fits = _reach(F.col("left"), F.col("most_left"), F.col("n"), F.col("least_n")) & (5 * F.col("n") >= 4 * F.col("least_n")) & (5 * F.col("most_n") >= 4 * F.col("n"))
    fits = fits & (9 * (F.col("n") - lacking(F.col("image"), F.col("union"))) >= 4 * (F.col("n") + F.col("least_n")))
    mine = prefix.join(matrix, (F.col("token") == F.col("t")) & (F.col("grp") != F.col("other")) & fits).select("token", "a", "n", "left", "image", "other")
    theirs = prefix.select(
        F.col("token").alias("t"), F.col("a").alias("d"), F.col("n").alias("dn"), F.col("left").alias("dleft"), F.col("grp").alias("dgrp"), F.col("image").alias("dimage"))
    pairs = mine.join(theirs, (F.col("token") == F.col("t")) & (F.col("other") == F.col("dgrp")) & (F.col("a") < F.col("d")) & _near())
    pairs = pairs.select(F.col("a").alias("u"), F.col("d").alias("v")).distinct()
    return out.unionByName(_similar_pairs(pairs, sets))


def _labelled(docs: DataFrame, filter_bits: int) -> DataFrame:
    """Rows (doc_id, n, a, root), one per document; documents of one component have one root. Method and cases as in `near_duplicates`."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stage(source.mapInArrow(describe, "doc_id long, n long, a long, b long"), "set-prints", TEXT_ROWS)
    rows = source.mapInArrow(meet_prefixes, "token long, a long, c int, n int, chunk int")
    met = rows.withColumn("chunk", F.col("chunk") + F.spark_partition_id() * 4096).repartition("token")
    same, own = W.partitionBy("token"), F.when(F.col("c") >= 0, F.col("a"))
    flagged = met.withColumn("shared", (F.min(own).over(same) != F.max(own).over(same)) | (F.min("c").over(same) < 0))
    counts = flagged.filter("c >= 0").groupBy("a", "chunk").agg(
        F.max("n").alias("n"), F.sum(F.when(F.col("n") > 0, F.col("c")).when(F.col("shared"), 1).otherwise(0)).alias("c"))
    size = F.least(F.col("n"), F.floor(F.col("n") / 5) + F.floor((F.col("n") + 9) / 10))
    enough = counts.filter((F.col("n") > 0) & (F.col("c") >= needed_in_prefix(F.col("n"))))
    survivors = stage(enough.groupBy("a").agg(F.min(size - F.col("c")).alias("private")), "survivors", TEXT_ROWS)
    reps = described.filter("n > 0").join(survivors, "a", "left_semi").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))

    # One document of each set passes, and few others do, which do no harm: similar sets among them are linked like any.
    known = key_filter(reps.select("doc_id", "a", "b"), filter_bits)
    sets = stage(source.mapInArrow(full_sets(known, filter_bits), "n long, a long, hashes array<long>, keys array<long>, image array<long>"), "full-sets", TEXT_ROWS)
    stars = stage(star_links(sets, survivors), "stars")
    groups = components(stars)
    between = links_between_groups(sets, groups)
    roots = components(stars.unionByName(between))
    labelled = described.select("doc_id", "n", "a").join(roots, F.col("a") == F.col("u"), "left").select("doc_id", "n", "a", F.coalesce("root", "a").alias("root"))
    return stage(labelled, "labelled")


def near_duplicates(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The component of every document in the graph of near-duplicate links.

    Words are runs without white space, A-Z lowered; a document's set holds its distinct 5-word shingles, or its whole word sequence if shorter. Two
    documents link if their sets' Jaccard similarity is 0.8 or more. Texts with equal sets are one set from the start.

    1. Each set is described by its size, two 64-bit prints and a prefix of its smallest hashes. Similar sets share at least a tenth of
       the smaller set in their prefixes, so sets with fewer prefix tokens in other sets drop out. One shuffle, combined in the tasks.
    2. The remaining sets are hashed in full. Each is compared with one set per key (`star_links`); components of those links are the groups.
    3. Links between groups come from the token-group matrix (`links_between_groups`). Together the links have the components of all links.

    Shingles and sets are told apart by 64-bit hashes. Null, empty and blank texts: 0 shingles, linked with nothing, not even with each other.
    A null doc_id counts for no component_id; it gets that of its component, or null. Repeated rows repeat. Other columns are dropped. Empty table: no rows.
    Returns doc_id, n_shingles, component_id, a (print of the set).
    """
    labelled = _labelled(docs, filter_bits)
    least = labelled.filter("n > 0").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("least"))
    out = labelled.join(least, (F.col("root") == F.col("r")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "a")


def with_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with n and the first print of their set."""
    for batch in batches:
        for first, rows, n, prints, _, _ in _sets(batch):
            columns = [batch.column(c).slice(first, rows) for c in ("doc_id", "text", "row")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), pa.array(prints[0])], names=["doc_id", "text", "row", "n", "a"])


def one_of_each_group(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Of the rows of each component, the one with the smallest doc_id. Cases as in `near_duplicates`; rows with a null id stay, as do rows without shingles.

    Rows may share a doc_id: a row is dropped by its id and the print of its set, so unlike text under the same id stays. Of rows with the
    smallest id of a component the one with the smallest print is kept, of equal prints the smallest text, then the smallest JSON of the row.
    """
    labelled = _labelled(docs, filter_bits).filter(F.col("doc_id").isNotNull())
    key = F.struct("doc_id", "a")
    kept = labelled.filter("n > 0").groupBy(F.col("root").alias("r")).agg(F.min(key).alias("kept"))
    gone = labelled.filter("n > 0").join(kept, F.col("root") == F.col("r")).filter(key != F.col("kept"))
    gone = stage(gone.select(F.col("doc_id").alias("gone_id"), F.col("a").alias("gone_a")).distinct(), "gone-rows")
    shared = stage(labelled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("doc_id").alias("shared_id")), "shared-ids")
    row_id = docs["doc_id"].cast("long")
    if shared.isEmpty():
        return docs.join(gone, row_id == F.col("gone_id"), "left_anti")
    alone = docs.join(shared, row_id == F.col("shared_id"), "left_anti")
    alone = alone.join(gone, row_id == F.col("gone_id"), "left_anti")
    several = docs.join(shared, row_id == F.col("shared_id"), "left_semi")
    several = several.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    schema = T.StructType([*several.schema.fields, T.StructField("n", T.LongType()), T.StructField("a", T.LongType())])
    several = several.mapInArrow(with_prints, schema)
    left = several.filter("n > 0").join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("a") == F.col("gone_a")), "left_anti")
    first = left.groupBy("doc_id", "a").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return alone.unionByName(several.filter("n = 0").select("row.*")).unionByName(first.select("row.*"))
