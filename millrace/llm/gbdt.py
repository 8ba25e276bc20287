"""Small gradient-boosted trees for two classes, with monotonic constraints.

Training takes a bounded sample in numpy; the trees are flattened into node
arrays, which score whole columns at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees. A leaf has the feature -1 and points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                goes = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(goes, self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _best_split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, n_bins: int, monotone: np.ndarray, low: float, high: float, l2: float, least: float):
    """(gain, feature, bin, left value, right value) or None; values are kept within low and high."""
    best = None
    all_g, all_h = g.sum(), h.sum()
    whole = all_g**2 / (all_h + l2)
    for f in range(binned.shape[1]):
        gl = np.cumsum(np.bincount(binned[:, f], g, n_bins))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], h, n_bins))[:-1]
        gr, hr = all_g - gl, all_h - hl
        vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - whole
        ok = (hl >= least) & (hr >= least) & (monotone[f] * (vr - vl) >= 0)
        gain = np.where(ok, gain, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
            best = (gain[at], f, at, vl[at], vr[at])
    return best


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic boosting of y (0 or 1).

    monotone has 1 for a feature with which the output may only rise, -1 for
    one with which it may only fall, else 0: a split that breaks this is not
    taken, and the halves below a constrained split stay on either side of the
    middle of their values. Without rows of both classes the result is constant.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        feature.append(-1), threshold.append(0.0), left.append(len(left)), right.append(len(right)), value.append(rate * v)
        return len(feature) - 1

    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(node(float(np.clip(-g.sum() / (h.sum() + l2), -8, 8))))
            todo = [(roots[-1], np.arange(len(y)), -8.0, 8.0, 0)]
            while todo:
                at, rows, low, high, level = todo.pop()
                split = _best_split(binned[rows], g[rows], h[rows], bins, monotone, low, high, l2, least) if level < depth else None
                if split is None:
                    margin[rows] += value[at]
                    continue
                _, f, cut, vl, vr = split
                goes = binned[rows, f] <= cut
                feature[at], threshold[at], middle = f, float(cuts[f][min(cut, len(cuts[f]) - 1)]), (vl + vr) / 2
                left[at], right[at] = node(vl), node(vr)
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(monotone[f]), ((low, high), (low, high)))
                todo += [(left[at], rows[goes], *bounds[0], level + 1), (right[at], rows[~goes], *bounds[1], level + 1)]
    return Trees(*(np.array(v, dtype=t) for v, t in ((feature, int), (threshold, float), (left, int), (right, int), (value, float), (roots, int))), depth, base)
