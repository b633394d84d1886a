"""Gradient-boosted trees of depth two for small tabular samples, and their form as a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Node = tuple  # (feature, threshold, left, right) or (value,)


def _best(x, g, h, rows, least=8):
    best = None
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v = x[order, f]
        gs, hs = np.cumsum(g[order]), np.cumsum(h[order])
        for i in np.flatnonzero(v[1:] != v[:-1]):
            if i + 1 < least or len(v) - i - 1 < least:
                continue
            gain = gs[i] ** 2 / (hs[i] + 1) + (gs[-1] - gs[i]) ** 2 / (hs[-1] - hs[i] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = (gain, f, (v[i] + v[i + 1]) / 2)
    return best


def _grow(x, g, h, rows, depth, rate) -> Node:
    best = _best(x, g, h, rows) if depth else None
    if best is None:
        return (rate * g[rows].sum() / (h[rows].sum() + 1),)
    _, f, t = best
    left = x[rows, f] <= t
    return (f, float(t), _grow(x, g, h, rows[left], depth - 1, rate), _grow(x, g, h, rows[~left], depth - 1, rate))


def _value(node: Node, x: np.ndarray) -> np.ndarray:
    if len(node) == 1:
        return np.full(len(x), node[0])
    f, t, a, b = node
    return np.where(x[:, f] <= t, _value(a, x), _value(b, x))


class Boosted:
    def __init__(self, start: float, trees: list[Node]):
        self.start, self.trees = start, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4) -> Boosted:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        model = cls(float(np.log(p / (1 - p))), [])
        z = np.full(len(y), model.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            tree = _grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, rate)
            model.trees.append(tree)
            z += _value(tree, x)
        return model

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for t in self.trees:
            z += _value(t, x)
        return 1 / (1 + np.exp(-z))

    def column(self, features: list[Column]) -> Column:
        """The same probability as a column expression."""

        def walk(node: Node) -> Column:
            if len(node) == 1:
                return F.lit(float(node[0]))
            f, t, a, b = node
            return F.when(features[f] <= t, walk(a)).otherwise(walk(b))

        z = F.lit(self.start)
        for t in self.trees:
            z = z + walk(t)
        return 1 / (1 + F.exp(-z))
