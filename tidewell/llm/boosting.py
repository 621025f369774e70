"""Gradient-boosted regression trees for two classes, small and without dependencies but NumPy.

Features are cut into at most ``BINS`` bins by quantiles of the fitting sample; trees grow level by
level on histograms of the logistic loss's gradients and curvatures.  Fitting is deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)  # -1: a leaf
    limit: list[float] = field(default_factory=list)  # go left at values up to it
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for name, x in (("feature", -1), ("limit", 0.0), ("left", -1), ("right", -1), ("value", 0.0)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, limit = np.array(self.feature), np.array(self.limit)
        left, right = np.array(self.left), np.array(self.right)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return np.array(self.value)[at]
            i = np.nonzero(inner)[0]
            n = at[i]
            at[i] = np.where(x[i, feature[n]] <= limit[n], left[n], right[n])


@dataclass
class Boosted:
    base: float
    trees: list[Tree]
    rate: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += self.rate * t.score(x)
        return 1.0 / (1.0 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, smooth: float = 1.0, least: float = 1e-3) -> Boosted:
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    model = Boosted(float(np.log(mean / (1 - mean))), [], rate)
    if len(y) < 2 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-z))
        grad, curve = y - p, p * (1 - p)
        tree, level = Tree(), [(0, np.arange(len(y)), 0)]
        tree.add()
        while level:
            node, rows, d = level.pop()
            g, h = grad[rows].sum(), curve[rows].sum()
            tree.value[node] = g / (h + smooth)
            if d == depth or len(rows) < 4:
                continue
            best = (least, -1, -1)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.bincount(binned[rows, j], weights=grad[rows], minlength=len(c) + 1).cumsum()[:-1]
                hs = np.bincount(binned[rows, j], weights=curve[rows], minlength=len(c) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + smooth) + (g - gs) ** 2 / (h - hs + smooth) - g**2 / (h + smooth)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] < 0:
                continue
            _, j, k = best
            go = binned[rows, j] <= k
            if go.all() or not go.any():
                continue
            tree.feature[node], tree.limit[node] = j, float(cuts[j][k])
            tree.left[node], tree.right[node] = tree.add(), tree.add()
            level += [(tree.left[node], rows[go], d + 1), (tree.right[node], rows[~go], d + 1)]
        model.trees.append(tree)
        z += rate * tree.score(x)
    return model


def calibrated_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1; of equals, the middle of the widest gap between scores."""
    if not len(y) or y.max() == 0:
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(np.diff(p[order]) != 0, True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)
