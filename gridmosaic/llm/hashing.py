"""Hashes of bytes and bounded filters of hashes, on numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FILTER_BITS = 1 << 26  # of the filter sent to the tasks: 8 MB
SLICE_BYTES = 1 << 20  # text hashed at a time

WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")  # a word in lowered UTF-8
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # translates A-Z

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finish)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


TABLE_PLACES = 64
PLACE_TABLE = mix(np.arange(TABLE_PLACES << 8, dtype=np.uint64), 31)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word low[start:end]: the scrambled sum of random numbers, one per byte value and place in the word.

    Unlike a polynomial of the bytes, the sum has no words that are bound to meet. Words lie one after another and do not overlap.
    """
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    symbol = low[np.repeat(starts, size) + place].astype(np.int64)
    drawn = PLACE_TABLE[(np.minimum(place, TABLE_PLACES - 1) << 8) | symbol]
    far = place >= TABLE_PLACES - 1
    if far.any():
        drawn[far] = mix(((place[far] << 8) | symbol[far]).view(np.uint64), 31)
    return mix(np.add.reduceat(drawn, first) + size.astype(np.uint64)) if len(size) else np.zeros(0, dtype=np.uint64)


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number of the first text, the bytes and the bounds of about `size` bytes of texts at a time."""
    texts = batch.column("text").cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
        a = b


def _bits(keys: np.ndarray, seed: int, bits: int) -> np.ndarray:
    return (mix(keys, seed) % np.uint64(bits)).astype(np.int64)


def joint(*columns: np.ndarray) -> np.ndarray:
    """One key of several 64-bit columns."""
    key = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        key = mix(key ^ c.view(np.uint64), 7)
    return key


def passes_filter(known: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """True for every member of the filter, and for others by chance."""
    passed = np.ones(len(keys), dtype=bool)
    for seed in (11, 12):
        at = _bits(keys, seed, bits)
        passed &= ((known[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return passed


def key_filter(rows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit filter of the rows of long columns, of a fixed size: it passes every member, and the more others the fuller it is.

    At most `bits` / 64 words come to the driver, whatever the number of rows.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = joint(*(c.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False) for c in batch.columns))
            at = np.concatenate([_bits(keys, seed, bits) for seed in (11, 12)])
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["w", "bit"])

    found = rows.mapInArrow(words, "w long, bit long").groupBy("w").agg(F.bit_or("bit").alias("bit")).toArrow()
    known = np.zeros((bits + 63) >> 6, dtype=np.uint64)
    known[found.column("w").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return known
