"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridmosaic.llm.common import hashed_sample, stage

FEATURES = (
    "log_words", "word_length", "distinct_words", "distinct_pairs", "same_neighbours", "top_word", "distinct_lines", "words_per_line",
    "upper", "digits", "symbols", "marks", "stops", "other_bytes",
)
UPPER, DIGITS, SYMBOLS, MARKS, STOPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>@^~=+_{}[]\\", b"!?", b".,;:")
OTHER = bytes(range(128, 256))
MAX_LABELLED = 50_000  # bound of the training sample


def text_features(text: str | None) -> list[float]:
    """Measures of one whole text; all 0 for null or blank text but for what a blank text has."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    chars = sum(map(len, words))

    def share(group: bytes) -> float:
        return (len(raw) - len(raw.translate(None, group))) / len(raw)

    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return [
        float(np.log1p(n)), chars / n, len(counts) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), sum(map(eq, words, words[1:])) / n,
        max(counts.values()) / n, len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        share(UPPER), share(DIGITS), share(SYMBOLS), share(MARKS), share(STOPS), share(OTHER),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(texts: pd.Series) -> pd.Series:
    """`text_features` of a batch."""
    return texts.map(text_features)


@dataclass(frozen=True)
class Model:
    """Lookup tables: one row of `tables` per feature, one matrix of `pair_tables` per pair of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1: the tables' values at the bins of each row, added."""
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int) -> np.ndarray:
    """A value per bin from a tree with few leaves over one feature: the best split of any leaf, again and again."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    cg, ch, cn = (np.concatenate([[0.0], np.cumsum(v)]) for v in (g, h, n))
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            s = np.arange(a + 1, b)
            if not len(s):
                continue
            left_g, left_h, right_g, right_h = cg[s] - cg[a], ch[s] - ch[a], cg[b] - cg[s], ch[b] - ch[s]
            gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
            gain = np.where((cn[s] - cn[a] >= least) & (cn[b] - cn[s] >= least), gain, -1)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), k, int(s[i]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, float]:
    """A tree of four leaves over two features: one cut of each; its values per cell and its gain."""
    def corner(v: np.ndarray) -> np.ndarray:
        return np.cumsum(np.cumsum(v, 0), 1)

    G, H, N = corner(g), corner(h), corner(n)
    gain = np.zeros_like(G[:-1, :-1])
    quadrants = []
    for V in (G, H, N):
        ll = V[:-1, :-1]
        lr, rl = V[:-1, -1:] - ll, V[-1:, :-1] - ll
        quadrants.append((ll, lr, rl, V[-1, -1] - ll - lr - rl))
    if not gain.size:
        return np.zeros_like(g), 0.0
    enough = np.ones_like(gain, dtype=bool)
    for qg, qh, qn in zip(*quadrants):
        gain = gain + qg**2 / (qh + 1)
        enough &= qn >= least
    gain = np.where(enough, gain - G[-1, -1] ** 2 / (H[-1, -1] + 1), 0.0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    if gain[i, j] > 0:
        cells = ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))
        for cell, qg, qh in zip(cells, quadrants[0], quadrants[1]):
            out[cell] = _leaf(qg[i, j], qh[i, j])
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, bins: int = 64, pair_bins: int = 12, rate: float = 0.15, leaves: int = 3, least: int = 5) -> Model:
    """Boost one shallow tree per feature and round in turn (cyclic), then the pairs with the largest gain on what is left.

    Each tree is added to the table of its feature, so the model is the sum of tables. With one class or no rows the model is
    the share of label 1 (0.5 without rows).
    """
    d = x.shape[1]
    rest = Model(0.0, [np.zeros(0)] * d, [np.zeros(1)] * d, [], [np.zeros(0)] * d, [])
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), rest.edges, rest.tables, [], rest.pair_edges, [])
    intercept = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), intercept)
    edges = [_edges(x[:, j], bins) for j in range(d)]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(binned, tables)]
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-total))
            g, h = (np.bincount(binned[j], weights=v, minlength=len(tables[j])) for v in (y - p, p * (1 - p)))
            step = rate * _shallow_tree(g, h, counts[j], leaves, least)
            tables[j] += step
            total += step[binned[j]]

    pair_edges = [_edges(x[:, j], pair_bins) for j in range(d)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]

    def grid(a: int, b: int, v: np.ndarray | None) -> np.ndarray:
        shape = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], weights=v, minlength=shape[0] * shape[1]).reshape(shape).astype(float)

    p = 1 / (1 + np.exp(-total))
    gains = [(_pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)), grid(a, b, None), least)[1], a, b) for a in range(d) for b in range(a + 1, d)]
    pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
    pair_tables = [np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)) for a, b in pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(pairs):
            p = 1 / (1 + np.exp(-total))
            step = rate * _pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)), grid(a, b, None), least)[0]
            pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return Model(intercept, edges, tables, pairs, pair_edges, pair_tables)


def held_out(doc_id: Column | str) -> Column:
    """True for the quarter of documents that never teach."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 4 == 2, F.lit(False))


def train(measured: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on documents with a label that are not held out, at most `max_labelled` of them.

    `measured` has doc_id and features. Above the bound the documents with the smallest hashes teach: a sample that the order of rows
    does not change. Null labels teach nothing; of several labels of a document the lowest counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min(label).alias("y"))
    rows = measured.select("doc_id", "features").join(known, "doc_id")
    sample = hashed_sample(rows, max_labelled, "doc_id", "features").select("features", (F.col("y") == 1).cast("double").alias("y")).toArrow()
    x = np.array(sample.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array(sample.column("y").to_pylist(), dtype=float))


def scorer(model: Model):
    """A column function from features to the score."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(np.array(batch.tolist(), dtype=float).reshape(-1, len(FEATURES))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Score of every document by its whole text: the chance that its label is 1.

    The text is read once; the features are kept as a slim table, taught from and scored. Labels, language, source and id are no inputs
    of a score, and held-out documents (crc32 of the id, remainder 2 of 4) never teach. Null and empty texts are scored like any other.
    A null id is never labelled. Repeated rows repeat. Other columns are dropped. Without labels of both classes all scores are one constant.
    Returns doc_id, held_out, score, predicted (1 if score >= threshold).
    """
    measured = stage(docs.select("doc_id", features("text").alias("features")), "quality-features")
    score = scorer(train(measured, labels, max_labelled=max_labelled))
    scored = measured.select("doc_id", held_out("doc_id").alias("held_out"), score("features").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Documents whose score reaches the threshold, with all their columns. Cases as in `score_documents`."""
    measured = stage(docs.select("doc_id", features("text").alias("features")), "quality-features")
    score = scorer(train(measured, labels, max_labelled=max_labelled))
    return docs.filter(score(features("text")) >= threshold)
