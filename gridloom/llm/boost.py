"""Gradient-boosted regression trees with a logistic loss, on binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Complete trees of one depth: a node is (feature, threshold); rows at most as large go left."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        binned = np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)])  # bin b: above cut b - 1, at most cut b
        self.depth, self.rate = depth, rate
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.feature = np.zeros((trees, 2**depth - 1), np.int64)
        self.threshold = np.full((trees, 2**depth - 1), np.inf, np.float32)
        self.value = np.zeros((trees, 2**depth))
        margin = np.full(n, self.start)
        offset = np.arange(width) * bins
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                nodes = 2**level
                cell = ((at * (width * bins))[:, None] + offset + binned).reshape(-1)
                shape = (nodes, width, bins)
                gs = np.bincount(cell, np.repeat(g, width), nodes * width * bins).reshape(shape).cumsum(2)
                hs = np.bincount(cell, np.repeat(h, width), nodes * width * bins).reshape(shape).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                best = gain.reshape(nodes, -1).argmax(1)
                feature, cut = best // bins, best % bins
                split = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
                for i in np.flatnonzero(split):
                    self.feature[t, nodes - 1 + i] = feature[i]
                    self.threshold[t, nodes - 1 + i] = cuts[feature[i]][cut[i]] if cut[i] < len(cuts[feature[i]]) else np.inf
                right = split[at] & (binned[np.arange(n), feature[at]] > cut[at])
                at = at * 2 + right
            top, bottom = np.bincount(at, g, 2**depth), np.bincount(at, h, 2**depth)
            self.value[t] = rate * top / (bottom + ridge)
            margin += self.value[t][at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = at * 2 + (x[rows, feature[node]] > threshold[node])
            out += value[at]
        return out
