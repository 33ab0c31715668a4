"""A random forest for small training sets: fitted with numpy on the driver, sent to tasks as a few arrays."""

from __future__ import annotations

import numpy as np


class Forest:
    """Binary classification trees on bootstrap samples, with random feature subsets and Gini splits."""

    def __init__(self, trees: int = 30, depth: int = 9, leaf: int = 3, seed: int = 7):
        self.n, self.depth, self.leaf, self.seed, self.trees = trees, depth, leaf, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.n):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list] = []
            self._grow(x[rows], y[rows].astype(float), 0, nodes, rng)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
        return self

    def _grow(self, x, y, depth, nodes, rng) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y.mean())])  # feature, threshold, left, right, share of ones
        if depth == self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return me
        best = (0.0, None, None)
        whole = y.mean() * (1 - y.mean())
        for f in rng.permutation(x.shape[1])[: max(1, int(np.sqrt(x.shape[1])) + 1)]:
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            n = np.arange(1, len(v))
            ones = np.cumsum(t)[:-1]
            a, b = ones / n, (t.sum() - ones) / (len(v) - n)
            gain = whole - (n * a * (1 - a) + (len(v) - n) * b * (1 - b)) / len(v)
            gain[(v[1:] == v[:-1]) | (n < self.leaf) | (len(v) - n < self.leaf)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-12:
                best = (gain[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] is None:
            return me
        go = x[:, best[1]] <= best[2]
        left = self._grow(x[go], y[go], depth + 1, nodes, rng)
        right = self._grow(x[~go], y[~go], depth + 1, nodes, rng)
        nodes[me][:4] = [int(best[1]), float(best[2]), left, right]
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of ones over the trees' leaves."""
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at].astype(int)
                inner = f >= 0
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at).astype(int)
            total += share[at]
        return total / max(1, len(self.trees))
