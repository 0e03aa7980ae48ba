"""Gradient-boosted trees for two classes over dense features, and isotonic calibration; plain numpy.

Trees are grown best leaf first on features cut into at most 64 bins, by the
gradients and curvatures of the logistic loss. Fitting takes a bounded sample;
scoring is vectorised over rows and needs only a few small arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return self.value[node]
            at = node[inner]
            low = x[inner, self.feature[at]] <= self.limit[at]
            node[inner] = np.where(low, self.left[at], self.right[at])


@dataclass
class Booster:
    """Sum of trees on the log-odds scale."""

    rounds: int = 60
    leaves: int = 12
    rate: float = 0.15
    least: int = 5
    ridge: float = 1.0
    bins: int = 64
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        self.trees = []
        share = (float(y.sum()) + 0.5) / (len(y) + 1) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1).astype(np.int64)
        total = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            tree = self._grow(binned, cuts, p - y, p * (1 - p))
            total += tree.score(x)
            self.trees.append(tree)
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray) -> Tree:
        features = binned.shape[1]
        shifted = binned + np.arange(features) * self.bins
        size = features * self.bins
        names = ("feature", "limit", "left", "right", "value")
        nodes: dict[str, list] = {n: [] for n in names}

        def leaf(rows: np.ndarray) -> tuple:
            at = len(nodes["feature"])
            s, c = slope[rows].sum(), curve[rows].sum()
            for n, v in zip(names, (-1, 0.0, -1, -1, -self.rate * s / (c + self.ridge))):
                nodes[n].append(v)
            flat = shifted[rows].ravel()
            sums = [np.cumsum(np.bincount(flat, np.repeat(w, features), size).reshape(features, self.bins), 1) for w in (slope[rows], curve[rows], np.ones(len(rows)))]
            ls, lc, ln = sums
            gain = ls**2 / (lc + self.ridge) + (s - ls) ** 2 / (c - lc + self.ridge) - s**2 / (c + self.ridge)
            gain[(ln < self.least) | (len(rows) - ln < self.least)] = -np.inf
            for f, cut in enumerate(cuts):
                gain[f, len(cut) :] = -np.inf
            best = int(np.argmax(gain))
            return float(gain.flat[best]), -at, best, rows

        open_ = [leaf(np.arange(len(slope)))]
        while open_ and len(open_) < self.leaves:
            top = max(range(len(open_)), key=lambda i: open_[i][:2])
            gain, minus_at, best, rows = open_[top]
            if not gain > 1e-9:
                break
            open_.pop(top)
            f, b = divmod(best, self.bins)
            low = binned[rows, f] <= b
            at = -minus_at
            nodes["feature"][at], nodes["limit"][at] = f, float(cuts[f][b])
            nodes["left"][at] = len(nodes["feature"])
            open_.append(leaf(rows[low]))
            nodes["right"][at] = len(nodes["feature"])
            open_.append(leaf(rows[~low]))
        return Tree(*(np.array(nodes[n]) for n in names))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.score(x) for t in self.trees), np.zeros(len(x)))


@dataclass
class Isotonic:
    """Least-squares non-decreasing map of scores to label shares, linear between the steps' centres."""

    at: np.ndarray = field(default_factory=lambda: np.zeros(0))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        """Pool neighbours that violate the order; equal scores are one point."""
        at, index, n = np.unique(score, return_inverse=True, return_counts=True)
        mean = np.bincount(index, y, len(at)) / np.maximum(n, 1)
        blocks: list[list[float]] = []
        for x, m, w in zip(at, mean, n):
            blocks.append([x * w, m * w, w])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.at = np.array([b[0] / b[2] for b in blocks])
        self.value = np.array([b[1] / b[2] for b in blocks])
        return self

    def map(self, score: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return 1 / (1 + np.exp(-score))
        return np.interp(score, self.at, self.value)
