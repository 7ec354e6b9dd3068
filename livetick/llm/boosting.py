"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """An ensemble of complete binary trees of one depth, grown by Newton steps on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> None:
        inner = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], inner)) for f in range(x.shape[1])]
        self.depth, self.trees = depth, []
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        binned = self.binned(x)
        margin = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, y - p, p * (1 - p), ridge, rate)
            self.trees.append(tree)
            margin += self._values(tree, binned)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1).astype(np.int64)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float, rate: float) -> tuple:
        n, width = b.shape
        node, feature, cut = np.zeros(n, np.int64), [], []
        for level in range(self.depth):
            nodes = 1 << level
            best, pick, at = np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, BINS)
            for f in range(width):
                key = node * BINS + b[:, f]
                left_g = np.cumsum(np.bincount(key, g, nodes * BINS).reshape(nodes, BINS), 1)
                left_h = np.cumsum(np.bincount(key, h, nodes * BINS).reshape(nodes, BINS), 1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_h < 1) | (all_h - left_h < 1)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(nodes), top]
                better = value > best + 1e-9
                best[better], pick[better], at[better] = value[better], f, top[better]
            feature.append(pick)
            cut.append(at)  # a node without a split sends all to the left
            node = node * 2 + (b[np.arange(n), pick[node]] > at[node])
        leaves = 1 << self.depth
        value = rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + ridge)
        return feature, cut, value

    def _values(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for pick, at in zip(feature, cut, strict=True):
            node = node * 2 + (b[rows, pick[node]] > at[node])
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        b = self.binned(x)
        return self.start + sum(self._values(t, b) for t in self.trees) if len(x) else np.zeros(0)
