"""Gradient-boosted trees with logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    base: float
    depth: int
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2**depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), (1 << self.depth) - 1
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 5.0) -> Trees:
    """Second-order boosting on quantile bins, all levels of a tree split at once. y: 0 or 1; both must occur."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)  # bin b: edges[b-1] < x <= edges[b]
    p = float(np.average(y, weights=weight))
    out = np.full(n, base := float(np.log(p / (1 - p))))
    feature, threshold, value = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-out))
        g, h = weight * (y - q), weight * q * (1 - q)
        at = np.zeros(n, np.int64)
        f_all, t_all = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            best = np.full(nodes, 1e-6)
            for j in range(d):
                if not len(edges[j]):
                    continue
                k = (at - first) * (bins + 1) + binned[:, j]
                gs = np.bincount(k, g, nodes * (bins + 1)).reshape(nodes, -1).cumsum(1)
                hs = np.bincount(k, h, nodes * (bins + 1)).reshape(nodes, -1).cumsum(1)
                gl, hl, ga, ha = gs[:, : len(edges[j])], hs[:, : len(edges[j])], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(nodes), top] > best):
                    best[i], f_all[first + i], t_all[first + i] = gain[i, top[i]], j, edges[j][top[i]]
            at = 2 * at + 1 + (x[np.arange(n), f_all[at]] > t_all[at])
        leaf = at - ((1 << depth) - 1)
        v = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        out += v[leaf]
        feature.append(f_all), threshold.append(t_all), value.append(v)
    return Trees(base, depth, np.array(feature), np.array(threshold), np.array(value))


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and the rising probabilities at them, to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, first and last score
    for s, v, w in zip(score[order], y[order], weight[order], strict=True):
        blocks.append([w, w * v, s, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, y2, _, last = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += y2
            blocks[-1][3] = last
    knots = np.array([z for b in blocks for z in (b[2], b[3])])
    values = np.array([b[1] / b[0] for b in blocks for _ in range(2)])
    return knots, values
