"""Resampling towards a target distribution by hashed n-gram importance weights."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmosaic.llm.common import stage
from gridmosaic.llm.hashing import LOWER, WORD_BYTES

SENTINEL = b"\n"  # no word crosses it

N_BUCKETS = 10_000
JOINED_BYTES = 1 << 20  # of texts joined for one pass; one longer text is joined alone
BLOCK_WORDS = 1 << 16  # matches held at a time
SCORE_STEP = 256  # scores per coarse step of the histogram


def joined_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """First row, the lowered texts of some rows joined by sentinels, and where each text starts in them."""
    texts = batch.column("text").cast(pa.large_binary())
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 1)
    a = 0
    while a < len(texts):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + JOINED_BYTES, side="right")))
        joined = SENTINEL.join(t or b"" for t in texts.slice(a, b - a).to_pylist()).translate(LOWER)
        yield a, joined, np.concatenate([[0], ends[a: b - 1] - before])
        a = b


def features_of(joined: bytes, starts: np.ndarray, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each feature, bucket of each feature, text of each word), block by block.

    One pass of the pattern finds the words of all texts. A run of words counts if its first and last word lie in one text, which the starts tell; the last
    n - 1 words of a block are carried into the next. The checksum of a run continues that of the run one word shorter.
    """
    matches = WORD_BYTES.finditer(joined)
    words: list[bytes] = []
    places: list[int] = []
    while block := list(islice(matches, BLOCK_WORDS)):
        carried = len(words)
        words += [m.group() for m in block]
        places += [m.start() for m in block]
        text = np.searchsorted(starts, np.array(places, dtype=np.int64), side="right") - 1
        sums = [crc32(w) for w in words]
        owners, hashes = [text[carried:]], [np.array(sums[carried:], dtype=np.int64)]
        for k in range(1, n):
            sums = [crc32(b" " + w, c) for w, c in zip(words[k:], sums)]
            first = max(0, carried - k)  # runs that end in a new word
            inside = (text[: len(text) - k] == text[k:])[first:]
            owners.append(text[first: len(text) - k][inside])
            hashes.append(np.array(sums[first:], dtype=np.int64)[inside])
        yield np.concatenate(owners), np.concatenate(hashes) % buckets, text[carried:]
        keep = min(n - 1, len(words))
        words, places = words[len(words) - keep:], places[len(places) - keep:]


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket. Every task adds up its own counts, so at most `buckets` rows leave it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, joined, starts in joined_texts(batch):
                for _, bucket, _ in features_of(joined, starts, n, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "c"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, c long")
    found = rows.groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()  # one row per bucket at most
    out = np.zeros(buckets, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("c").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of the smoothed share in the target over that in the corpus)."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = ((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """doc_id, n_words, n_features and weight: the mean gain of the features, floored; 0 without features."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, joined, starts in joined_texts(batch):
                size = len(starts)
                words, features, total = (np.zeros(size, dtype=np.int64) for _ in range(3))
                for owner, bucket, text in features_of(joined, starts, n, buckets):
                    words += np.bincount(text, minlength=size)
                    features += np.bincount(owner, minlength=size)
                    total += np.bincount(owner, weights=gain[bucket], minlength=size).astype(np.int64)
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, size), *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: Column) -> Column:
    """A Gumbel draw in thousandths that depends on the seed and the id only."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u)))


def ranked_draw(scored: DataFrame, share: tuple[int, int], min_words: int) -> DataFrame:
    """Adds `rank` to the rows with the highest scores, as many as the share of those with enough words; null elsewhere.

    Scores are whole numbers in a range that weights and noise bound, so a histogram of them has a bounded number of rows, whatever the number of documents.
    It gives the score at which the draw ends and the rows above each score; rows of one score are numbered among themselves. No task sorts the table.
    """
    enough = scored.filter(F.col("n_words") >= min_words)
    step = F.floor(F.col("score") / SCORE_STEP)
    counts = stage(enough.groupBy("score").agg(F.count(F.lit(1)).alias("c")).withColumn("step", step), "score-counts")
    above_steps = counts.groupBy("step").agg(F.sum("c").alias("c")).select("step", (F.sum("c").over(W.orderBy(F.desc("step"))) - F.col("c")).alias("above"))
    within = W.partitionBy("step").orderBy(F.desc("score"))
    places = counts.join(above_steps, "step").select("score", "c", (F.col("above") + F.sum("c").over(within) - F.col("c")).alias("above"))
    wanted = counts.agg(F.floor(F.coalesce(F.sum("c"), F.lit(0)) * share[0] / share[1])).scalar()
    reached = stage(places.withColumn("wanted", wanted).filter(F.col("above") < F.col("wanted")), "score-places")

    joined = scored.join(reached, "score", "left")
    drawn = joined.filter(F.col("above").isNotNull() & (F.col("n_words") >= min_words))
    place = F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "n_words")) + F.col("above")
    rank = F.when(place <= F.col("wanted"), place).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = joined.filter(F.col("above").isNull() | (F.col("n_words") < min_words)).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*columns, rank).unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = N_BUCKETS, share: tuple[int, int] = (10, 100), min_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """Draws documents that look like the target texts, without replacement, by Gumbel noise on their importance weights.

    Features are runs of 1 to `n` words in one text, A-Z lowered, hashed to buckets by crc32. The texts of a batch are joined by sentinels, one pass of a pattern
    finds all words, and the starts of the texts, looked up by `searchsorted`, tell apart the runs that cross a border. Both tables are counted in full.

    Null and empty texts have no features and weight 0. A null doc_id draws its noise from the empty string and comes last among ties. Repeated rows are drawn one by one. Long texts
    are read in blocks of words. Empty tables: no rows, or a target without features. Other columns are dropped, whatever their names.
    Returns doc_id, n_features, weight, score, rank (1 is the highest score; ties to the smaller doc_id; null if not drawn).
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    weighed = weigh(docs, gain, n)
    scored = stage(weighed.withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))), "weights")
    return ranked_draw(scored, share, min_words)
