"""Binned decision trees on numpy: a random forest and gradient boosting, small and deterministic.

Trees are stored as flat arrays, so that they can be applied to a matrix or written as a
Column. Training runs on the driver over a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    """feature[i] < 0: node i is a leaf with value[i]; else go left where x[feature] <= cut."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def apply(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        while (live := feature[at] >= 0).any():
            i = np.flatnonzero(live)
            n = at[i]
            at[i] = np.where(x[i, feature[n]] <= cut[n], left[n], right[n])
        return np.array(self.value)[at]

    def column(self, names: list[str], node: int = 0) -> Column:
        """The same as an expression over columns of those names."""
        if self.feature[node] < 0:
            return F.lit(float(self.value[node]))
        return F.when(F.col(names[self.feature[node]]) <= float(self.cut[node]), self.column(names, self.left[node])).otherwise(self.column(names, self.right[node]))


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int, damp: float, pick: int | None, rng: np.random.Generator) -> Tree:
    """A tree that fits -grad / hess, by exact gains over at most 32 cuts a feature."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    tree = Tree([], [], [], [], [])

    def node(rows: np.ndarray, d: int) -> int:
        me = len(tree.feature)
        g, h = grad[rows].sum(), hess[rows].sum()
        for part, v in ((tree.feature, -1), (tree.cut, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, float(-g / (h + damp)))):
            part.append(v)
        if d == 0 or len(rows) < 2 * least:
            return me
        best = (1e-9, -1, 0.0)
        tried = range(x.shape[1]) if pick is None else sorted(rng.choice(x.shape[1], pick, replace=False).tolist())
        for j in tried:
            c = cuts[j]
            slot = np.searchsorted(c, x[rows, j], side="left")
            n = np.cumsum(np.bincount(slot, minlength=len(c) + 1))[:-1]
            gl = np.cumsum(np.bincount(slot, grad[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(slot, hess[rows], len(c) + 1))[:-1]
            gain = gl**2 / (hl + damp) + (g - gl) ** 2 / (h - hl + damp) - g**2 / (h + damp)
            gain[(n < least) | (len(rows) - n < least)] = 0
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), j, float(c[k]))
        if best[1] < 0:
            return me
        go = x[rows, best[1]] <= best[2]
        tree.feature[me], tree.cut[me] = best[1], best[2]
        tree.left[me] = node(rows[go], d - 1)
        tree.right[me] = node(rows[~go], d - 1)
        return me

    node(np.arange(len(x)), depth)
    return tree


def forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 6, seed: int = 11) -> list[Tree]:
    """Random forest: bootstrap rows, a random part of the features at each node, leaves hold the share of y."""
    rng = np.random.default_rng(seed)
    pick = max(1, int(np.sqrt(x.shape[1]) + 1))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        out.append(grow(x[rows], -y[rows].astype(float), np.ones(len(rows)), depth, 5, 1e-9, pick, rng))
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 13) -> tuple[float, list[Tree]]:
    """Gradient boosting of the logistic loss; leaf values hold the rate. Returns the prior and the trees."""
    rng = np.random.default_rng(seed)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    prior = float(np.log(p / (1 - p)))
    f, out = np.full(len(y), prior), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        t = grow(x, q - y, q * (1 - q), depth, 5, 1.0, None, rng)
        t.value = [v * rate for v in t.value]
        f += t.apply(x)
        out.append(t)
    return prior, out


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset, with his smoothed targets, by Newton steps."""
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * score + b)))
        g = np.array([((p - t) * score).sum(), (p - t).sum()])
        w = p * (1 - p) + 1e-9
        hess = np.array([[(w * score**2).sum(), (w * score).sum()], [(w * score).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
