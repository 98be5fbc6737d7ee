"""Gradient-boosted trees for two classes, in numpy, with binned features."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete trees of one depth under the log loss, grown on second-order gains."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0):
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        self.depth = depth
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        inner = 2**depth - 1
        self.feature = np.zeros((trees, inner), np.int64)
        self.cut = np.full((trees, inner), np.inf)
        self.leaf = np.zeros((trees, 2**depth))
        score = np.full(n, self.bias)
        flat = binned + np.arange(width) * bins
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, curve = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, many = 2**level - 1, 2**level
                at = (flat + (node - first)[:, None] * (width * bins)).ravel()
                g = np.bincount(at, np.repeat(grad, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2)
                h = np.bincount(at, np.repeat(curve, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2)
                all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[(h < 1) | (all_h - h < 1)] = -1
                best = gain.reshape(many, -1).argmax(axis=1)
                for k in range(many):
                    f, b = divmod(int(best[k]), bins)
                    if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                        self.feature[t, first + k], self.cut[t, first + k] = f, edges[f][b]
                node = self._down(x, t, node)
            leaf = node - inner
            self.leaf[t] = rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, curve, 2**depth) + ridge)
            score += self.leaf[t][leaf]

    def _down(self, x: np.ndarray, t: int, node: np.ndarray) -> np.ndarray:
        return 2 * node + 1 + (x[np.arange(len(x)), self.feature[t][node]] > self.cut[t][node])

    def logits(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = self._down(x, t, node)
            score += self.leaf[t][node - (2**self.depth - 1)]
        return score
