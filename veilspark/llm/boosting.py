"""Gradient boosting of shallow trees with logistic loss, in numpy: histograms to grow, table look-ups to predict."""

from __future__ import annotations

import numpy as np


class Boosted:
    """trees complete trees of the given depth; features are cut into at most bins values."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, least: int = 20, shrink: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.shrink = trees, depth, rate, bins, least, shrink
        self.base = 0.0
        self.features = self.cuts = self.leaves = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
        mean = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.base)
        inner, outer = 2**self.depth - 1, 2**self.depth
        self.features = np.zeros((self.trees, inner), dtype=np.int64)
        self.cuts = np.full((self.trees, inner), np.inf)
        self.leaves = np.zeros((self.trees, outer))
        width = self.bins + 1
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-9)
                for j in range(d):
                    if not len(edges[j]):
                        continue
                    at = node * width + binned[:, j]
                    hist = [np.bincount(at, w, count * width).reshape(count, width) for w in (g, h, None)]
                    gl, hl, nl = (np.cumsum(x, axis=1) for x in hist)
                    gs, hs, ns = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                    gain = gl**2 / (hl + self.shrink) + (gs - gl) ** 2 / (hs - hl + self.shrink) - gs**2 / (hs + self.shrink)
                    gain[(nl < self.least) | (ns - nl < self.least)] = 0
                    k = gain[:, : len(edges[j])].argmax(axis=1)
                    top = gain[np.arange(count), k]
                    for i in np.nonzero(top > best)[0]:
                        best[i] = top[i]
                        self.features[t, first + i], self.cuts[t, first + i] = j, edges[j][k[i]]
                f, c = self.features[t, first + node], self.cuts[t, first + node]
                node = 2 * node + (x[np.arange(n), f] > c)
            gs, hs = np.bincount(node, g, outer), np.bincount(node, h, outer)
            self.leaves[t] = self.rate * gs / (hs + self.shrink)
            score += self.leaves[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        columns = np.ascontiguousarray(x.T)
        n = len(x)
        score = np.full(n, self.base)
        rows = np.arange(n)
        for f, c, leaves in zip(self.features, self.cuts, self.leaves):
            node = (columns[f[0]] > c[0]).astype(np.int64)
            for level in range(1, self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (columns[f[at], rows] > c[at])
            score += leaves[node]
        return 1 / (1 + np.exp(-score))
