"""Histogram gradient-boosted trees in numpy, flattened into arrays, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees: feature and threshold of each inner node by level, value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic loss, second-order gains; a node that no split improves sends all to its left."""
    n, k = x.shape
    inner = (1 << depth) - 1
    share = float(np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4))
    out = Trees(float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if not n or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    xb = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(k)], 1)  # bin b: x <= edges[b]
    cell = xb + np.arange(k) * bins
    margin = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 1 << level
            at = (cell + (node * k * bins)[:, None]).ravel()
            gs = np.bincount(at, np.repeat(g, k), width * k * bins).reshape(width, k, bins).cumsum(2)
            hs = np.bincount(at, np.repeat(h, k), width * k * bins).reshape(width, k, bins).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = 0
            for j in range(k):
                gain[:, j, len(edges[j]) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            f, b = best // bins, best % bins
            place = width - 1 + np.arange(width)
            out.feature[t, place] = np.where(good, f, 0)
            out.threshold[t, place] = [edges[j][c] if ok else np.inf for j, c, ok in zip(f, b, good, strict=True)]
            cut = np.where(good, b, bins)
            node = 2 * node + (xb[np.arange(n), np.where(good, f, 0)[node]] > cut[node])
        gl, hl = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        out.leaf[t] = -rate * gl / (hl + l2)
        margin += out.leaf[t][node]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending scores and the values to interpolate between."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # value sum, weight, score sum
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, w2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + w2, blocks[-1][2] + s2]
    xs = np.array([0.0, *(b[2] / b[1] for b in blocks), 1.0])
    ys = np.array([b[0] / b[1] for b in blocks])
    return xs, np.concatenate([ys[:1] * 0.5, ys, 1 - (1 - ys[-1:]) * 0.5])
