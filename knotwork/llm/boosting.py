"""Gradient-boosted trees on binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Trees:
    """Complete trees of one depth: feature and cut of inner node i (children 2 i + 1, 2 i + 2), values of the leaves."""

    base: float = 0.0
    depth: int = 3
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 3.0, decay: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss; splits are sought over quantile bins."""
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    model = Trees(float(np.log(p / (1 - p))), depth)
    if not len(y) or len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        q = sigmoid(raw)
        g, h = y - q, q * (1 - q)
        n_inner = (1 << depth) - 1
        f, c = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            best = np.zeros(n)
            bin_cut = np.full(n, bins)
            for j in range(x.shape[1]):
                key = (node - first) * bins + code[:, j]
                gs, hs = (np.bincount(key, w, n * bins).reshape(n, bins).cumsum(1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + decay) + (gt - gs) ** 2 / (ht - hs + decay) - gt**2 / (ht + decay)
                gain[(hs < least / 4) | (ht - hs < least / 4)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(1)
                better = np.flatnonzero(gain[np.arange(n), k] > best + 1e-9)
                best[better] = gain[better, k[better]]
                f[first + better], bin_cut[better] = j, k[better]
                c[first + better] = [edges[j][i] for i in k[better]]
            own = f[node]
            node = 2 * node + 1 + (code[np.arange(len(y)), own] > bin_cut[node - first])
        leaf = node - n_inner
        value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + decay)
        raw += value[leaf]
        model.feature.append(f)
        model.cut.append(c)
        model.value.append(value)
    return model


@dataclass
class Isotonic:
    x: np.ndarray
    y: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0.0, 1.0)


def fit_isotonic(score: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
    """Pool adjacent violators. Pools are shrunk a little to the mean, so no score is an outright 0 or 1."""
    if not len(y):
        return Isotonic(np.zeros(1), np.full(1, 0.5))
    order = np.argsort(score, kind="stable")
    mean = float(y.mean())
    pools: list[list[float]] = []  # sum, count, least and most score
    for s, v in zip(score[order], y[order].astype(float), strict=True):
        pools.append([v, 1.0, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v2, n2, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + v2, pools[-1][1] + n2, pools[-1][2], hi]
    xs = np.array([e for p in pools for e in (p[2], p[3])])
    ys = np.maximum.accumulate(np.array([v for p in pools for v in [(p[0] + prior * mean) / (p[1] + prior)] * 2]))
    return Isotonic(xs, ys)


def fit_calibrated(x: np.ndarray, y: np.ndarray, folds: int = 4, **how: float) -> tuple[Trees, Isotonic]:
    """Trees on all rows; calibration on scores of rows that their trees have not seen."""
    part = np.arange(len(y)) % folds
    out = np.zeros(len(y))
    for k in range(folds if len(y) >= 8 * folds else 0):
        out[part == k] = fit_trees(x[part != k], y[part != k], **how).raw(x[part == k])
    model = fit_trees(x, y, **how)
    return model, fit_isotonic(out if len(y) >= 8 * folds else model.raw(x), y)
