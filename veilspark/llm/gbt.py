"""Gradient-boosted regression trees for binary labels, small enough to train on a bounded sample.

A trained model scores rows as one Spark SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trees:
    """``base`` log-odds and trees; a node is a leaf value or (feature, threshold, left, right), left where feature < threshold."""

    base: float
    trees: tuple

    def margin(self, names: list[str]) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(F.col(names[feature]) < threshold, walk(left)).otherwise(walk(right))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + walk(tree)
        return out

    def score(self, names: list[str]) -> Column:
        return 1 / (1 + F.exp(-self.margin(names)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting on quantile bins; deterministic.  One class or no rows give a constant model."""
    if not len(y) or y.min() == y.max():
        return Trees(0.0 if not len(y) else (4.0 if y[0] else -4.0), ())
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1)
    margin, trees = np.full(len(y), base), []

    def grow(rows, grad, hess, left):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        if left and len(rows) >= 10:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gs = np.bincount(binned[rows, j], grad[rows], len(e) + 1).cumsum()[:-1]
                hs = np.bincount(binned[rows, j], hess[rows], len(e) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] is None:
            value = float(-rate * g / (h + ridge))
            margin[rows] += value
            return value
        _, j, k = best
        low = binned[rows, j] <= k
        return (j, float(edges[j][k]), grow(rows[low], grad, hess, left - 1), grow(rows[~low], grad, hess, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
    return Trees(base, tuple(trees))
