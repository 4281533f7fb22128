"""Gradient-boosted regression trees on the logistic loss, in numpy, for some tens of features and thousands of rows."""

from __future__ import annotations

import numpy as np

DEPTH, TREES, RATE, BINS, LEAST = 4, 60, 0.25, 32, 8


class Boosted:
    """Trees of fixed depth stored as arrays: feature, threshold and, at the leaves, value."""

    def __init__(self):
        self.bias, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], axis=1)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(mean / (1 - mean)))
        margin = np.full(len(y), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._tree(binned, cuts, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    @staticmethod
    def _tree(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple:
        inner = 2**DEPTH - 1
        feature, threshold, value = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2**DEPTH)
        at = np.zeros(len(g), int)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, None, None)
            if len(rows) >= 2 * LEAST:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, q in enumerate(cuts):
                    if not len(q):
                        continue
                    b = binned[rows, f]
                    gl, hl = np.bincount(b, g[rows], len(q) + 1).cumsum()[:-1], np.bincount(b, h[rows], len(q) + 1).cumsum()[:-1]
                    n = np.bincount(b, minlength=len(q) + 1).cumsum()[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
            if best[1] is not None:
                feature[node], threshold[node] = best[1], cuts[best[1]][best[2]]
                at[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
            else:
                at[rows] = 2 * node + 1
        for leaf in range(2**DEPTH):
            rows = at == inner + leaf
            value[leaf] = -RATE * g[rows].sum() / (h[rows].sum() + 1)
        return feature, threshold, value

    @staticmethod
    def _walk(tree: tuple, x: np.ndarray) -> np.ndarray:
        feature, threshold, value = tree
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        return value[at - (2**DEPTH - 1)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = self.bias + sum(self._walk(t, x) for t in self.trees)
        return 1 / (1 + np.exp(-margin))
