"""Gradient-boosted trees for two classes, on a sample that fits one process.

Features are cut into bins at quantiles; each round grows a tree on the gradients
of the logistic loss. For a feature with a monotonic constraint only splits that
keep the order of the two sides' values are taken, and the middle between these
values bounds all that grows below either side, so the sum of trees is monotonic
in the feature. Trees are flattened into arrays of nodes, and rows go down all
trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins of a feature, at most.
BINS = 64
#: Weight added to the curvature of a leaf, and the least that a side must have.
RIDGE, LEAST = 1.0, 2.0


@dataclass
class Forest:
    """Nodes of all trees. ``feature`` is -1 in leaves, rows with a value of at
    most ``cut`` go ``left``; ``roots`` has each tree's first node."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row of ``x``."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.start)
        at = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        while True:
            asked = self.feature[at]
            if (asked < 0).all():
                return self.start + self.value[at].sum(axis=1)
            low = x[row, np.maximum(asked, 0)] <= self.cut[at]
            at = np.where(asked < 0, at, np.where(low, self.left[at], self.right[at]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def cuts_of(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Ascending values between the bins of a feature."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[:-1] + distinct[1:]) / 2
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def fit(
    x: np.ndarray, y: np.ndarray, signs: tuple[int, ...] = (), rounds: int = 60, depth: int = 4, rate: float = 0.2
) -> Forest:
    """Trees for rows ``x`` with classes ``y`` (0 or 1).

    ``signs`` has 1 for features in which the score may only rise, -1 where it may
    only fall, 0 for others. Rows are put in order first, so the trees do not
    depend on that of the input. With rows of one class only, or none, the
    score is a constant.
    """
    order = np.lexsort((*x.T, y)) if x.size else np.arange(len(y))
    x, y = x[order], y[order].astype(float)
    signs = np.array(signs or [0] * x.shape[1])
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots: list[int] = []
    if 0 < y.sum() < len(y):
        cuts = [cuts_of(c) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        margin = np.full(len(y), start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grown = _Tree(codes, cuts, p - y, p * (1 - p), signs, depth, nodes)
            roots.append(grown.grow(np.arange(len(y)), -np.inf, np.inf, 0))
            margin += rate * grown.found
    made = np.array(nodes, float).reshape(-1, 5)
    whole = made[:, [0, 2, 3]].astype(np.int64)
    return Forest(start, np.array(roots, np.int64), whole[:, 0], made[:, 1], whole[:, 1], whole[:, 2], rate * made[:, 4])


class _Tree:
    def __init__(self, codes, cuts, gradient, curvature, signs, depth, nodes):
        self.codes, self.cuts, self.g, self.h = codes, cuts, gradient, curvature
        self.signs, self.depth, self.nodes = signs, depth, nodes
        self.found = np.zeros(len(gradient))

    def grow(self, rows: np.ndarray, low: float, high: float, level: int) -> int:
        """Add the node for ``rows``, whose values lie between the bounds; its number."""
        number = len(self.nodes)
        g, h = self.g[rows].sum(), self.h[rows].sum()
        value = float(np.clip(-g / (h + RIDGE), low, high))
        self.nodes.append([-1, 0.0, number, number, value])
        self.found[rows] = value
        split = self._best(rows, g, h, low, high, value) if level < self.depth else None
        if split is None:
            return number
        feature, bin_, left_value, right_value = split
        below = self.codes[rows, feature] <= bin_
        bounds = [(low, high), (low, high)]
        if sign := self.signs[feature]:
            middle = (left_value + right_value) / 2
            bounds = [(low, middle), (middle, high)] if sign > 0 else [(middle, high), (low, middle)]
        left = self.grow(rows[below], *bounds[0], level + 1)
        right = self.grow(rows[~below], *bounds[1], level + 1)
        self.nodes[number][:4] = [feature, float(self.cuts[feature][bin_]), left, right]
        return number

    def _best(self, rows, g, h, low, high, value):
        def gain(g, h, w):
            return -(g * w + 0.5 * (h + RIDGE) * w * w)

        best, least = None, gain(g, h, value) + 1e-6
        for feature, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            code = self.codes[rows, feature]
            gl = np.cumsum(np.bincount(code, self.g[rows], len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(code, self.h[rows], len(cuts) + 1))[:-1]
            gr, hr = g - gl, h - hl
            wl = np.clip(-gl / (hl + RIDGE), low, high)
            wr = np.clip(-gr / (hr + RIDGE), low, high)
            total = gain(gl, hl, wl) + gain(gr, hr, wr)
            ok = (hl >= LEAST) & (hr >= LEAST) & (self.signs[feature] * (wr - wl) >= 0)
            total = np.where(ok, total, -np.inf)
            k = int(np.argmax(total))
            if total[k] > least:
                best, least = (feature, k, float(wl[k]), float(wr[k])), total[k]
        return best
