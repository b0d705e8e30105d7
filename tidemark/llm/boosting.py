"""Histogram gradient-boosted trees for 0/1 labels, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold by inner node, value by leaf."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2**depth)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x: all trees walk down level by level."""
        n, (trees, inner) = len(x), self.feature.shape
        total = np.full(n, self.base)
        rows = np.arange(n)
        for t in range(trees):
            node = np.zeros(n, np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.value[t, node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Fit to rows x and labels y; a split must leave `least` of second derivative (rows, roughly a quarter each) on both sides."""
    n, width = x.shape if len(y) else (0, x.shape[1])
    inner, leaves = 2**depth - 1, 2**depth
    mean = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    if not n:
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best, where = np.full(wide, 1e-6), np.full((wide, 2), -1)
            for f in range(width):
                key = (node - first) * bins + binned[:, f]
                g = np.bincount(key, grad, wide * bins).reshape(wide, bins)
                h = np.bincount(key, hess, wide * bins).reshape(wide, bins)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = -1
                gain[:, len(edges[f]) :] = -1
                k = gain.argmax(1)
                better = gain[np.arange(wide), k] > best
                best[better] = gain[np.arange(wide), k][better]
                where[better] = np.stack([np.full(wide, f), k], axis=1)[better]
            for j in range(wide):
                f, k = where[j]
                if f >= 0:
                    out.feature[t, first + j], out.threshold[t, first + j] = f, edges[f][k]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.threshold[t, node])
        leaf = node - inner
        out.value[t] = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        total += out.value[t, leaf]
    return out
