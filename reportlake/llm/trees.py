"""Histogram gradient-boosted trees for a binary label, in numpy, flattened into arrays for traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node arrays of all trees: a leaf is its own child. A row goes left where its feature is at most the cut."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row of x."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(1))))


def fitted(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, least: float = 8.0, ridge: float = 1.0) -> Forest:
    """Logistic boosting. Each level of a tree is one histogram of gradients over (node, feature, bin)."""
    rate_of_1 = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    bias = float(np.log(rate_of_1 / (1 - rate_of_1)))
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros(1, int), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.zeros(1), np.zeros(1, int), 0, bias)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    n, k = x.shape
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        feature.append(0), cut.append(0.0), left.append(len(left)), right.append(len(right)), value.append(0.0)
        return len(value) - 1

    raw = np.full(n, bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(node())
        at, open_ = np.full(n, roots[-1]), [roots[-1]]
        for level in range(depth + 1):
            place = np.full(len(value), -1)
            place[open_] = np.arange(len(open_))
            slot = place[at]
            live = slot >= 0
            sums_g, sums_h = (np.bincount(slot[live], w[live], len(open_)) for w in (g, h))
            for i, o in enumerate(open_):
                value[o] = -rate * sums_g[i] / (sums_h[i] + ridge)
            if level == depth:
                break
            cells = (slot[live, None] * k + np.arange(k)) * bins + binned[live]
            gl, hl = (np.bincount(cells.ravel(), np.repeat(w[live], k), len(open_) * k * bins).reshape(len(open_), k, bins).cumsum(2) for w in (g, h))
            gr, hr = sums_g[:, None, None] - gl, sums_h[:, None, None] - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (sums_g**2 / (sums_h + ridge))[:, None, None]
            gain[(hl < least) | (hr < least)] = 0
            opened = []
            for i, o in enumerate(open_):
                best = int(gain[i].argmax())
                f, b = divmod(best, bins)
                if gain[i, f, b] <= 1e-6 or b >= len(cuts[f]):
                    continue
                feature[o], cut[o] = f, float(cuts[f][b])
                left[o], right[o] = node(), node()
                mine = at == o
                at[mine] = np.where(binned[mine, f] <= b, left[o], right[o])
                value[o] = 0.0
                opened += [left[o], right[o]]
            if not opened:
                break
            open_ = opened
        raw += np.array(value)[at]
    return Forest(*(np.array(v) for v in (feature, cut, left, right, value, roots)), depth, bias)
