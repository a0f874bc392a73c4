"""A small gradient-boosted tree classifier (logistic loss, quantile bins, depth-limited trees)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Trees as arrays: node ``i`` of a tree sends rows with ``x[feature[i]] <= cut[i]`` to ``2 i + 1``, others to ``2 i + 2``."""

    prior: float
    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, leaf: int = 10) -> Boosted:
    """Newton boosting; splits maximise the second-order gain over quantile cuts."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = [np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)]
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    prior = float(np.log(rate_of / (1 - rate_of)))
    margin = np.full(len(y), prior)
    size = 2 ** (depth + 1) - 1
    all_f, all_c, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        members = {0: np.arange(len(y))}
        for node in range(size):
            rows = members.pop(node, None)
            if rows is None:
                continue
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value[node] = -rate * total_g / (total_h + 1)
            if node >= 2**depth - 1 or len(rows) < 2 * leaf:
                continue
            best = (1e-6, -1, 0)
            own_g, own_h = g[rows], h[rows]
            for j, c in enumerate(cuts):
                n, at = len(c) + 1, binned[j][rows]
                gl = np.cumsum(np.bincount(at, own_g, n))[:-1]
                hl = np.cumsum(np.bincount(at, own_h, n))[:-1]
                nl = np.cumsum(np.bincount(at, minlength=n))[:-1]
                gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                gain[(nl < leaf) | (len(rows) - nl < leaf)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
            _, j, b = best
            if j < 0:
                continue
            feature[node], cut[node] = j, cuts[j][b]
            left = binned[j][rows] <= b
            members[2 * node + 1], members[2 * node + 2] = rows[left], rows[~left]
        tree = Boosted(0.0, feature[None], cut[None], value[None])
        margin = margin + tree.margin(x)
        all_f.append(feature)
        all_c.append(cut)
        all_v.append(value)
    return Boosted(prior, np.array(all_f), np.array(all_c), np.array(all_v))
