"""Hard negatives by rotated one-bit codes with exact intervals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gridmosaic.llm.common import stage

LEVELS = 4  # one-bit codes per vector: of the vector, of what the first leaves, and so on
PLANES = 6  # bits per component of an anchor
BLOCK_ROWS = 8192  # vectors per block
ANCHOR_ROWS = 2048  # anchors per block
LARGEST = 1 << 28  # of a component, so that every score fits a long
SLACK = 1e-6  # relative, for sums of doubles

BLOCK_SCHEMA = "d int, g int, ids binary, labels binary, ints binary, codes binary, aligned binary, rest binary"


def rotation(d: int) -> np.ndarray:
    """The same random rotation of d dimensions in every task."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diagonal(r))


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(np.uint64)


def encode(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, alignments and norms of what is left, per vector and level.

    A code is the vector of signs of what the levels before left, at unit length; the alignment is the inner product of both, which is never negative.
    What a level leaves is at right angles to its code.
    """
    n, d = ints.shape
    left = ints.astype(np.float64) @ rotation(d).T
    codes, aligned, rest = [], np.empty((n, LEVELS)), np.empty((n, LEVELS))
    for k in range(LEVELS):
        bits = left >= 0
        aligned[:, k] = np.abs(left).sum(axis=1) / np.sqrt(d)
        left -= np.where(bits, 1.0, -1.0) * (aligned[:, k, None] / np.sqrt(d))
        rest[:, k] = np.linalg.norm(left, axis=1)
        codes.append(words_of(bits))
    return np.stack(codes, axis=1), aligned, rest


@dataclass
class Block:
    """Vectors with their codes."""

    ids: np.ndarray
    labels: np.ndarray
    ints: np.ndarray
    codes: np.ndarray
    aligned: np.ndarray
    rest: np.ndarray

    @classmethod
    def read(cls, table: pa.Table) -> Block:
        d = table.column("d")[0].as_py()
        raw = {c: table.column(c)[0].as_buffer() for c in ("ids", "labels", "ints", "codes", "aligned", "rest")}
        ids, labels = (np.frombuffer(raw[c], np.int64) for c in ("ids", "labels"))
        n = len(ids)
        return cls(ids, labels, np.frombuffer(raw["ints"], np.int32).reshape(n, d), np.frombuffer(raw["codes"], np.uint64).reshape(n, LEVELS, -1),
                   np.frombuffer(raw["aligned"]).reshape(n, LEVELS), np.frombuffer(raw["rest"]).reshape(n, LEVELS))


class Anchor:
    """Bit planes of a rotated vector, and the intervals of its scores."""

    def __init__(self, ints: np.ndarray):
        self.ints = ints.astype(np.int64)
        turned = rotation(len(ints)) @ ints.astype(np.float64)
        self.d, self.norm = len(ints), float(np.linalg.norm(turned))
        self.low, top = float(turned.min()), float(turned.max())
        self.step = max(top - self.low, 1e-12) / ((1 << PLANES) - 1)
        units = np.rint((turned - self.low) / self.step).astype(np.int64)
        self.units = int(units.sum())
        self.planes = [words_of((units >> p & 1).astype(bool)) for p in range(PLANES)]
        # A code has components of one size, so the rounding of the planes moves an estimate by so much at most.
        self.error = float(np.abs(turned - (self.low + self.step * units)).sum()) / np.sqrt(self.d)

    def along(self, code: np.ndarray) -> np.ndarray:
        """The inner products with codes, up to `error`, from population counts."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        weighted = sum((np.bitwise_count(code & plane).sum(axis=1, dtype=np.int64) << p for p, plane in enumerate(self.planes)), np.zeros(len(code), np.int64))
        return (self.step * (2 * weighted - self.units) + self.low * (2 * ones - self.d)) / np.sqrt(self.d)

    def narrow(self, block: Block, rows: np.ndarray, keep) -> np.ndarray:
        """Rows left when `keep` has seen the intervals of each level.

        A score is the sum of alignments times inner products with the codes, and the inner product with what is left. That is at right angles to the last
        code, so by Cauchy and Schwarz it is at most its norm times that of the anchor without its part along this code.
        """
        centre, spread = np.zeros(len(rows)), np.zeros(len(rows))
        for k in range(LEVELS):
            along, aligned, rest = self.along(block.codes[rows, k]), block.aligned[rows, k], block.rest[rows, k]
            centre = centre + aligned * along
            spread = spread + aligned * self.error
            across = np.sqrt(np.maximum(self.norm ** 2 - np.maximum(np.abs(along) - self.error, 0) ** 2, 0))
            width = spread + rest * across
            width += SLACK * (1 + np.abs(centre) + width)
            kept = keep(centre - width, centre + width)
            rows, centre, spread = rows[kept], centre[kept], spread[kept]
        return rows

    def scores(self, block: Block, rows: np.ndarray) -> np.ndarray:
        return block.ints[rows].astype(np.int64) @ self.ints


def nth_largest(x: np.ndarray, n: int) -> float:
    return np.partition(x, len(x) - n)[len(x) - n] if len(x) >= n else -np.inf


def build_blocks(table: pa.Table) -> pa.Table:
    """One row with the vectors of a block and their codes. Of rows with one vec_id the one with the smallest label, then vector, stays."""
    d, g = table.column("d")[0].as_py(), table.column("g")[0].as_py()
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    ints = table.column("ints").combine_chunks().flatten().to_numpy().astype(np.int32).reshape(len(ids), d)
    order = np.lexsort((*ints.T[::-1], labels, ids))
    order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
    codes, aligned, rest = encode(ints[order])
    values = [x.tobytes() for x in (ids[order], labels[order], ints[order], codes, aligned, rest)]
    return pa.table([pa.array([d], pa.int32()), pa.array([g], pa.int32()), *(pa.array([v], pa.binary()) for v in values)],
                    names=["d", "g", "ids", "labels", "ints", "codes", "aligned", "rest"])


def chosen_anchors(every: int):
    """The anchors of the blocks, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.read(pa.Table.from_batches([batch.slice(i, 1)]))
                rows = np.flatnonzero(block.ids % every == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), block.ints.shape[1], np.int32)), pa.array(block.ids[rows]), pa.array(block.labels[rows]),
                     pa.array([block.ints[r].tobytes() for r in rows], pa.binary())], names=["d", "anchor_id", "label", "anchor"])

    return run


def find_positives(n: int):
    """The n best other rows of an anchor's label in a block. A row whose interval ends below n others begin cannot be one."""

    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        block, out = Block.read(blocks), []
        for anchor_id, label, raw in zip(*(anchors.column(c).to_pylist() for c in ("anchor_id", "label", "anchor"))):
            anchor = Anchor(np.frombuffer(raw, np.int32))
            rows = np.flatnonzero((block.labels == label) & (block.ids != anchor_id))
            rows = anchor.narrow(block, rows, lambda low, high: high >= nth_largest(low, n))
            scores = anchor.scores(block, rows)
            best = np.lexsort((block.ids[rows], -scores))[:n]
            out += [(anchor_id, int(block.ids[rows[i]]), int(scores[i])) for i in best]
        return pa.table(list(zip(*out)) or [[], [], []], schema=pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]))

    return run


def find_negatives(n: int, least: int, most: int):
    """For each anchor and positive the n best rows of other labels in a block whose score is between the two hundredths of the positive's."""

    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        block, out = Block.read(blocks), []
        for anchor_id, label, raw, positives in zip(*(anchors.column(c).to_pylist() for c in ("anchor_id", "label", "anchor", "positives"))):
            anchor = Anchor(np.frombuffer(raw, np.int32))
            ranges = [(p["positive_id"], p["positive_score"], -(-least * p["positive_score"] // 100), most * p["positive_score"] // 100) for p in positives]

            def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
                kept = np.zeros(len(low), dtype=bool)
                for _, _, a, b in ranges:
                    sure = low[(low >= a) & (high <= b)]  # certainly in the range
                    kept |= (high >= max(a, nth_largest(sure, n))) & (low <= b)
                return kept

            rows = anchor.narrow(block, np.flatnonzero(block.labels != label), wanted)
            scores = anchor.scores(block, rows)
            order = np.lexsort((block.ids[rows], -scores))
            for positive_id, positive_score, a, b in ranges:
                best = order[(scores[order] >= a) & (scores[order] <= b)][:n]
                out += [(anchor_id, positive_id, int(block.ids[rows[i]]), positive_score, int(scores[i])) for i in best]
        names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        return pa.table(list(zip(*out)) or [[]] * 5, schema=pa.schema([(c, pa.int64()) for c in names]))

    return run


def vectors_of(rows: DataFrame) -> DataFrame:
    """vec_id, label, ints, d of the rows that take part."""
    x = F.transform(F.col("embedding"), lambda v: F.floor(v.cast("double") * 256))
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) >= LARGEST / 256.0))
    sound = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0").filter(~odd)
    return sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.cast("array<int>").alias("ints"), F.size("embedding").alias("d"))


def _on_grid(anchors: DataFrame, blocks: DataFrame, sizes: tuple[int, int], run, schema: str) -> DataFrame:
    """`run` on every block of anchors and every block of vectors: each is sent to the cells of its row or column, so no cell holds more than one of both."""
    n_blocks, n_anchors = sizes
    left = anchors.withColumn("h", F.pmod(F.xxhash64("anchor_id"), F.lit(n_anchors)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = blocks.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))))
    keys = ["d", "g", "h"]

    def cell(anchor_rows: pa.Table, block_rows: pa.Table) -> pa.Table:
        if not anchor_rows.num_rows or not block_rows.num_rows:
            return run(anchor_rows.slice(0, 0), block_rows) if block_rows.num_rows else pa.table([[]] * len(names), names=names).cast(empty)
        return run(anchor_rows, block_rows)

    names = [c.split()[0] for c in schema.split(", ")]
    empty = pa.schema([(c, pa.int64()) for c in names])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def mine_hard_negatives(
    rows: DataFrame, anchor_every: int = 100, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90,
    block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """Hard negatives of each anchor (rows whose vec_id is divisible by `anchor_every`) and each of its positives.

    Scores are inner products of floor(256 x). An anchor's positives are its `n_positives` best other rows of the same label; the negatives of a positive are the `n_negatives` best rows
    of other labels that score from `least` to `most` hundredths of the positive's score. Ties go to the smaller vec_id.

    Vectors are turned at random and coded by their signs, and what that leaves again, `LEVELS` times; codes, alignments and norms are stored by blocks of about `block_rows` vectors.
    Anchors meet every block. Population counts estimate a score, a deterministic bound on what the codes leave gives an interval, and rows whose interval
    cannot reach the result drop out level by level. What survives is scored in whole numbers, so the result is exact. Two passes: positives, then negatives.

    Rows without vec_id, label or vector, with an empty vector or with a component that is null, not finite or 2^20 or larger take no part. Vectors meet those of their own length only.
    Of rows with one vec_id the one with the smallest label, then vector, counts. Empty table: no rows. Other columns are dropped.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    vectors = vectors_of(rows)
    count = vectors.count()
    sizes = max(1, -(-count // block_rows)), max(1, -(-count // (anchor_every * anchor_rows)))
    grouped = vectors.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(sizes[0])).cast("int")).groupBy("d", "g")
    blocks = stage(grouped.applyInArrow(build_blocks, BLOCK_SCHEMA), "vector-blocks")
    anchors = stage(blocks.mapInArrow(chosen_anchors(anchor_every), "d int, anchor_id long, label long, anchor binary"), "anchors")

    positives = _on_grid(anchors, blocks, sizes, find_positives(n_positives), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = positives.withColumn("place", place).filter(F.col("place") <= n_positives).groupBy("anchor_id")
    ranked = best.agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    with_positives = stage(anchors.join(ranked, "anchor_id"), "anchors-with-positives")

    names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
    negatives = _on_grid(with_positives, blocks, sizes, find_negatives(n_negatives, least, most), ", ".join(f"{c} long" for c in names))
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    out = negatives.withColumn("rank", rank).filter(F.col("rank") <= n_negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
