"""Gradient-boosted trees on binned features, trained on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees of one depth over binned features: at each inner node go right if the bin is above the cut."""

    intercept: float
    edges: list[np.ndarray]
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = bins_of(x, self.edges)
        total, rows = np.full(len(x), self.intercept), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, f[at]] > c[at])
            total += leaf[at - len(f)]
        return total


def bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), dtype=int)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.2, ridge: float = 1.0) -> Forest:
    """Boost trees on the log loss: each level of a tree is split for all its nodes from one histogram per feature."""
    d, inner = x.shape[1], (1 << depth) - 1
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned, width = bins_of(x, edges), bins
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    intercept = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), intercept)
    features, cuts, leaves = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), width, dtype=np.int64), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            local, best = at - first, np.full(n, 1e-9)
            for j in range(d):
                key = local * width + binned[:, j]
                sg, sh = (np.cumsum(np.bincount(key, weights=v, minlength=n * width).reshape(n, width), axis=1) for v in (g, h))
                lg, lh = sg[:, :-1], sh[:, :-1]
                rg, rh = sg[:, -1:] - lg, sh[:, -1:] - lh
                gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - sg[:, -1:] ** 2 / (sh[:, -1:] + ridge)
                cut = gain.argmax(axis=1)
                top = gain[np.arange(n), cut]
                better = top > best
                best[better] = top[better]
                features[t, first: first + n][better], cuts[t, first: first + n][better] = j, cut[better]
            at = 2 * at + 1 + (binned[np.arange(len(y)), features[t, at]] > cuts[t, at])
        leaf = at - inner
        sums = [np.bincount(leaf, weights=v, minlength=inner + 1) for v in (g, h)]
        leaves[t] = rate * sums[0] / (sums[1] + ridge)
        total += leaves[t][leaf]
    return Forest(intercept, edges, features, cuts, leaves, depth)
