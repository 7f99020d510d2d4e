"""Removal of repeated byte strings: suffix sorting of what can repeat."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from gridmosaic.llm.common import TEXT_ROWS, stage
from gridmosaic.llm.hashing import BASE, BASE_INVERSE, FILTER_BITS, joint, key_filter, mix, passes_filter, powers, slices
from gridmosaic.llm.induced import repeated_windows

WIDTH = 100
GRAM = 20
CHUNK_RUNS = 1 << 18  # runs met before they leave a task
SLICE_BYTES = 1 << 18  # of texts cut into runs at a time; each byte becomes several numbers for a while
SHARD_BYTES = 2 << 20  # a gram with more bytes of strings is split
SORT_BYTES = 1 << 19  # strings of several grams sorted at a time
DEPTHS = (2, 4, 0)  # smallest grams that key the parts of a large gram, one split after the other; 0: all bytes of each window
PART_STRINGS = 256  # strings split at a time
SAMPLE = 16  # one text in so many is read to find grams of many runs
HOT_RUNS, HOT_GRAMS = 256, 10_000  # runs in the sample from which a gram is dealt by its runs, and how many such grams the tasks are told


def runs_of(raw: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that agree in their smallest gram: (text number, start in the text, length, gram hash, hash of the run's bytes).

    A window's gram is the one with the smallest hash of those inside it, the leftmost of equals, so equal windows have
    equal grams at equal places. Windows side by side mostly share theirs; a run is the string such windows cover. No window leaves its text.
    """
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if len(raw) < width:
        return none
    up, down = powers(BASE, len(raw)), powers(BASE_INVERSE, len(raw))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, w = width - gram + 1, 1
    while 2 * w <= span:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if span > w:
        least = np.minimum(least[: len(raw) - width + 1], least[span - w: span - w + len(raw) - width + 1])
    inside = np.zeros(len(raw) + 1, dtype=np.int32)
    sizes = np.diff(bounds)
    long_enough = np.flatnonzero(sizes >= width)
    np.add.at(inside, bounds[:-1][long_enough], 1)
    np.add.at(inside, bounds[1:][long_enough] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(at):
        return none
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1])]))
    last = np.append(first[1:], len(at)) - 1
    start, length = at[first], at[last] - at[first] + width
    prints = mix((sums[start + length] - sums[start]) * down[start] + length.astype(np.uint64), 5)
    text = np.searchsorted(bounds, start, side="right") - 1
    return text, start - bounds[text], length, grams[place[first]].view(np.int64), prints.view(np.int64)


def parts_of(raw: np.ndarray, bounds: np.ndarray, keys: np.ndarray, width: int, gram: int, depth: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of short strings that agree in their `depth` smallest grams: (string number, offset, length, key, hash of the run's bytes).

    Equal windows have equal smallest grams at equal places, so equal windows of strings with one key get one key again: that key with the grams
    and how far they are from each other. Depth 0 gives every window alone, with a key of all its bytes.
    """
    up, down = powers(BASE, len(raw)), powers(BASE_INVERSE, len(raw))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    inside = np.maximum(np.diff(bounds) - width + 1, 0)
    string = np.repeat(np.arange(len(inside)), inside)
    at = np.arange(len(string)) - np.repeat(np.cumsum(inside) - inside, inside) + bounds[string]
    key = keys.view(np.uint64)[string]
    if depth:
        grams = mix((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        span = width - gram + 1
        depth = min(depth, span)
        smallest = np.sort(np.partition(least[at[:, None] + np.arange(span)], depth - 1, axis=1)[:, :depth], axis=1)
        places = (smallest & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for k in range(depth):
            key = mix(key ^ grams[places[:, k]], 8) + (places[:, k] - places[:, 0]).astype(np.uint64)
        new = (string[1:] != string[:-1]) | (places[1:] != places[:-1]).any(axis=1)
    else:
        key = mix(key ^ mix((sums[at + width] - sums[at]) * down[at], 9), 8)
        new = np.ones(max(0, len(at) - 1), dtype=bool)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), dtype=bool), new]))
    last = np.append(first[1:], len(at))[: len(first)] - 1
    start, length = at[first], at[last] - at[first] + width
    prints = mix((sums[start + length] - sums[start]) * down[start] + length.astype(np.uint64), 5)
    return string[first], start - bounds[string[first]], length, key[first].view(np.int64), prints.view(np.int64)


def meet_parts(width: int, gram: int, depth: int):
    """A task that gives the parts of its strings; as in `meet_runs`, of equal ones met in a chunk only the earliest keeps its key, and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        bodies: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)]
            string, offset = columns[6:]
            order, keys, known = _earliest(*columns[:6])
            k1, k2, start, length, _, prints = (x[order] for x in columns[:6])
            body = [None if k or not depth else bodies[s][o: o + n] for s, o, n, k in zip(string[order], offset[order], length, known)]
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, (keys, prints, length.astype(np.int32), k1, k2, start, known)), pa.array(body, type=pa.binary())],
                names=["gram", "print", "length", "k1", "k2", "start", "known", "body"])

        for batch in batches:
            grams, k1, k2, start = (batch.column(c).to_numpy() for c in ("gram", "k1", "k2", "start"))
            texts = batch.column("body").to_pylist()
            for a in range(0, len(texts), PART_STRINGS):
                some = texts[a: a + PART_STRINGS]
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in some])])
                string, offset, length, keys, prints = parts_of(np.frombuffer(b"".join(some), dtype=np.uint8), bounds, grams[a: a + PART_STRINGS], width, gram, depth)
                held.append((k1[a + string], k2[a + string], start[a + string] + offset, length, keys, prints, len(bodies) + string, offset))
                bodies += some
                size += len(string)
                if size >= CHUNK_RUNS // 4:
                    yield flush()
                    held, bodies, size = [], [], 0
        if held:
            yield flush()

    return run


def _earliest(k1: np.ndarray, k2: np.ndarray, start: np.ndarray, length: np.ndarray, grams: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which runs leave a chunk, in order, their keys, and whether they are known to repeat: of equal runs only the earliest keeps its gram as key."""
    order = np.lexsort((start, k1, length, prints, grams))
    k1, k2, start, length, grams, prints = (x[order] for x in (k1, k2, start, length, grams, prints))
    new = np.ones(len(k1), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (prints[1:] != prints[:-1]) | (length[1:] != length[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    known = (k1 != k1[head]) | (start != start[head])
    keys = np.where(known, mix((prints ^ k1 ^ start).view(np.uint64), 6).view(np.int64), grams)
    keep = new | known
    return order[keep], keys[keep], known[keep]


def meet_runs(width: int, gram: int, hot: np.ndarray | None = None):
    """A task that gives the runs of its texts; of equal runs met in a chunk only the earliest keeps its gram.

    The others are known to repeat (`known`) and leave under a key of their own, so a run has one row per chunk under its gram,
    however often it occurs. Rows are dealt by `deal`: the gram, and for `hot` grams (sorted) gram and print.
    """
    hot = np.zeros(0, dtype=np.int64) if hot is None else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)]
            order, keys, known = _earliest(*columns)
            k1, k2, start, length, _, prints = (x[order] for x in columns)
            many = np.isin(keys, hot)
            deal = np.where(many, mix((keys ^ prints).view(np.uint64), 10).view(np.int64), keys)
            return pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (keys, prints, length.astype(np.int32), k1, k2, start, known, many, deal)],
                names=["gram", "print", "length", "k1", "k2", "start", "known", "many", "deal"])

        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for first, raw, bounds in slices(batch, SLICE_BYTES):
                text, *found = runs_of(raw, bounds, width, gram)
                held.append((k1[first + text], k2[first + text], *found))
                size += len(text)
                if size >= CHUNK_RUNS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, `TEXT_ROWS` at a time, so that few texts become Python values at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, TEXT_ROWS):
            yield batch.slice(a, TEXT_ROWS)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of each text."""
    for batch in few_rows(batches):
        rows = {"gram": [], "k1": [], "k2": [], "start": [], "body": []}
        for k1, k2, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "wanted"))):
            raw = text.encode("utf-8")
            for w in wanted:
                for name, v in (("gram", w["gram"]), ("k1", k1), ("k2", k2), ("start", w["start"]), ("body", raw[w["start"]: w["start"] + w["length"]])):
                    rows[name].append(v)
            if len(rows["gram"]) > 20_000:
                yield _cut_batch(rows)
                rows = {name: [] for name in rows}
        if rows["gram"]:
            yield _cut_batch(rows)


def _cut_batch(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = {"gram": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "start": pa.int64(), "body": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(rows[n], type=t) for n, t in kinds.items()], names=list(kinds))


def spans_of(strings: list[bytes], k1: np.ndarray, k2: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Spans (k1, k2, start, length) of the windows that occur earlier, overlapping ones of a string joined."""
    classes, string, offset = repeated_windows(strings, width)
    key, at = k1[string], start[string] + offset
    order = np.lexsort((at, key, classes))
    classes, string, offset, key, at = (x[order] for x in (classes, string, offset, key, at))
    new = np.ones(len(classes), dtype=bool)
    new[1:] = classes[1:] != classes[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, dtype=np.int64)
    later = (key != key[head]) | (at != at[head])
    string, offset = string[later], offset[later]
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    first = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(string) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(string)) - 1 if len(first) else first
    s = string[first]
    return k1[s], k2[s], start[s] + offset[first], offset[last] - offset[first] + width


def sort_shards(width: int, sort_bytes: int = SORT_BYTES):
    """A task that sorts the suffixes of its strings; strings of different grams have no window in common.

    Whole grams are sorted together as long as they have at most `sort_bytes`, a larger one for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body: list[bytes] = []
        rows: list[np.ndarray] = []
        size, gram = 0, None

        def flush() -> pa.RecordBatch:
            k1, k2, start = np.concatenate(rows, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in spans_of(body, k1, k2, start, width)], names=["k1", "k2", "start", "length"])

        for batch in batches:
            grams = batch.column("gram").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, dtype=np.int64)
            keys = np.stack([batch.column(c).to_numpy() for c in ("k1", "k2", "start")])
            texts = batch.column("body").to_pylist()
            for a, b in zip(cuts, np.append(cuts[1:], len(grams))):
                more = sum(map(len, texts[a:b]))
                if body and size + more > sort_bytes and grams[a] != gram:
                    yield flush()
                    body, rows, size = [], [], 0
                gram = grams[a]
                body += texts[a:b]
                rows.append(keys[:, a:b])
                size += more
        if body:
            yield flush()

    return run


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes of their spans."""
    for batch in few_rows(batches):
        out = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = (text or "").encode("utf-8")
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["start"] + x["length"]) for x in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            at, parts = 0, []
            for a, b in merged:
                parts.append(raw[at:a])
                at = b
            parts.append(raw[at:])
            for name, v in (("n_bytes", len(raw)), ("n_removed", sum(b - a for a, b in merged)), ("n_spans", len(merged)), ("kept", b"".join(parts))):
                out[name].append(v)
        yield pa.RecordBatch.from_arrays([out["doc_id"], *(pa.array(out[n], type=pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], type=pa.binary())], names=list(out))


def _split(docs: DataFrame, keys: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Documents whose key passes a bounded filter of `keys` (all that are in it, and a few more), and the others, which are not in it."""
    known = key_filter(keys.select("k1", "k2"), bits)

    @F.pandas_udf(T.BooleanType())
    def passes(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(passes_filter(known, joint(k1.to_numpy(), k2.to_numpy()), bits))

    flag = passes("k1", "k2")
    return docs.filter(flag), docs.filter(~flag)


RUNS = "gram long, print long, length int, k1 long, k2 long, start long, known boolean, many boolean, deal long"
PARTS = "gram long, print long, length int, k1 long, k2 long, start long, known boolean, body binary"
STRINGS, SPANS = "gram long, k1 long, k2 long, start long, body binary", "k1 long, k2 long, start long, length long"


def _hot_grams(texts: DataFrame, width: int, gram: int, sample: int, hot_runs: int) -> np.ndarray:
    """Grams with many different runs in a sample of the texts. They are only dealt otherwise, so the rows do not depend on the sample."""
    few = texts.filter(F.pmod(F.xxhash64("k1", "k2"), F.lit(sample)) == 0).mapInArrow(meet_runs(width, gram), RUNS)
    counts = few.filter("not known").groupBy("gram").count().filter(F.col("count") >= hot_runs)
    return np.sort(np.array([r["gram"] for r in counts.orderBy(F.desc("count"), "gram").limit(HOT_GRAMS).collect()], dtype=np.int64))


def _judge(rows: DataFrame, *deal: str) -> DataFrame:
    """Runs with `later`: an equal one stands earlier, and `first`: the one of its kind that is looked at."""
    same, place = W.partitionBy(*deal, "gram", "print", "length").orderBy("k1", "start"), F.struct("k1", "start")
    judged = rows.withColumn("head", F.first(place).over(same))
    return judged.withColumn("later", F.col("known") | (place != F.col("head"))).withColumn("first", F.row_number().over(same) == 1)


def _sorted_spans(strings: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    return strings.select("gram", "k1", "k2", "start", "body").repartition("gram").sortWithinPartitions("gram").mapInArrow(sort_shards(width, min(shard_bytes, SORT_BYTES)), SPANS)


def _split_spans(strings: DataFrame, width: int, gram: int, shard_bytes: int) -> list[DataFrame]:
    """Spans of the windows that occur earlier, of strings whose gram has more bytes than a task sorts.

    The strings are cut into parts under keys of more grams (`parts_of`). Equal parts meet as hashes like runs do; of the keys under which
    different parts meet the small ones are sorted, the large ones split again. In the end windows meet by all their bytes, so nothing is left to sort.
    """
    found, span = [], F.col("length").cast("long").alias("length")
    for depth in DEPTHS:
        parts = strings.select("gram", "k1", "k2", "start", "body").mapInArrow(meet_parts(width, gram, depth), PARTS).repartition("gram", "print")
        parts = stage(_judge(parts).filter("later or first").withColumn("body", F.when(~F.col("later"), F.col("body"))).drop("head", "known"), "repeat-parts")
        found.append(parts.filter("later").select("k1", "k2", "start", span))
        if not depth:
            break
        kinds = F.struct("print", "length")
        keys = parts.filter("not later").groupBy("gram").agg(F.min(kinds).alias("lo"), F.max(kinds).alias("hi"), F.sum("length").alias("size"))
        keys = stage(keys.filter("lo <> hi").select("gram", "size"), "part-keys")
        heads = parts.filter("not later")
        found.append(_sorted_spans(heads.join(keys.filter(F.col("size") <= shard_bytes), "gram", "left_semi"), width, shard_bytes))
        large = keys.filter(F.col("size") > shard_bytes)
        if large.isEmpty():
            break
        strings = heads.join(large, "gram", "left_semi")
    return found


def drop_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, filter_bits: int = FILTER_BITS, shard_bytes: int = SHARD_BYTES, sample: int = SAMPLE, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Texts without the bytes covered by a string of `width` bytes that also starts earlier.

    Texts are UTF-8 bytes; matches never cross texts; earlier means a smaller doc_id, or the same and an earlier start; strings are judged on the input.

    1. Every text is cut into runs of windows with one smallest gram. Equal windows have equal grams, so runs meet by gram, as hashes: a gram met
       once is no repeat, and of runs equal in gram, length and 64-bit print all but the earliest are removed whole. Grams that have many runs in a sample
       of the texts are dealt by run, so no task gets them whole.
    2. Only where different runs share a gram are their bytes looked at: they go to the shard of the gram, and each shard's suffixes are
       sorted by induction with disk-backed queues (`induced.py`). Neighbours with a common prefix of `width` bytes are equal windows.
       A gram with more than `shard_bytes` of different runs is split (`_split_spans`), so a task sorts about twice that at most.
    3. Spans are joined per document and cut out. Documents without a span skip the join, told apart by a filter of fixed size, which may let others in.

    Null text is empty; a null doc_id comes before all others. Rows equal in doc_id are one document: what stands at the same place of both
    is not earlier. Texts shorter than `width` stay. Kept bytes may end inside a character, so they are binary. Other columns are dropped. Empty table: no rows.
    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"k1": F.coalesce("doc_id", F.lit(-(1 << 63))), "k2": F.xxhash64("text")})
    texts = docs.filter(F.octet_length("text") >= width).select("k1", "k2", "text")
    runs = texts.mapInArrow(meet_runs(width, gram, _hot_grams(texts, width, gram, sample, hot_runs)), RUNS).repartition("deal")
    kinds, shared = F.struct("print", "length"), W.partitionBy("deal", "gram")
    judged = _judge(runs, "deal").withColumn("met", F.col("many") | (F.min(kinds).over(shared) != F.max(kinds).over(shared)))
    judged = stage(judged.filter("later or (first and met)").select("gram", "length", "k1", "k2", "start", "later"), "repeated-runs", TEXT_ROWS)

    known = docs.select("k1", "k2", "text")

    def strings(of: DataFrame) -> DataFrame:
        wanted = of.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "start", "length")).alias("wanted"))
        some, _ = _split(known, of.select("k1", "k2").distinct(), filter_bits)
        return some.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(cut, STRINGS)

    heads = judged.filter("not later")
    large = stage(heads.groupBy("gram").agg(F.sum("length").alias("size")).filter(F.col("size") > shard_bytes).select("gram"), "large-grams")
    some_large = not large.isEmpty()
    found = [judged.filter("later").select("k1", "k2", "start", F.col("length").cast("long").alias("length"))]
    found.append(_sorted_spans(strings(heads.join(large, "gram", "left_anti") if some_large else heads), width, shard_bytes))
    if some_large:
        found += _split_spans(strings(heads.join(large, "gram", "left_semi")), width, gram, shard_bytes)
    spans = stage(reduce(DataFrame.unionByName, found), "repeat-spans", TEXT_ROWS)

    per_doc = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    maybe, clean = _split(docs, spans.select("k1", "k2").distinct(), filter_bits)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    changed = maybe.join(per_doc, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(removed, schema)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    zero = F.lit(0).cast("long")
    same_text = clean.select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), body.alias("kept"))
    return changed.unionByName(same_text)
