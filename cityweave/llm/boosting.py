"""Gradient-boosted trees on the logistic loss, with monotonic constraints, flattened for vectorised scoring.

Training works on histograms of at most `BINS` quantile bins per feature. A constraint of -1 (or +1) on a feature means
that the score never rises (or falls) with it: splits against it are not taken, and the values below a split are bounded
by the middle of its two sides. A model is a set of numpy node arrays; a row walks all trees by array lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Nodes of all trees one after the other; a leaf has feature -1 and is its own child."""

    feature: np.ndarray
    threshold: np.ndarray  # a row goes left if its value is less or equal
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' values for the rows of x."""
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                go_left = x[row, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(f < 0, node, np.where(go_left, self.left[node], self.right[node]))
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values that separate its bins; a value is in the first bin whose edge it doesn't exceed."""
    out = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)))
        out.append((values[1:] + values[:-1]) / 2 if len(values) > 1 else np.zeros(0))
    return out


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> Forest:
    n, width = x.shape
    edges = bin_edges(x)
    codes = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    rate_of = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
    base = float(np.log(rate_of / (1 - rate_of)))
    margin = np.full(n, base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def best_split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        gs, hs = g[rows].sum(), h[rows].sum()
        clip = lambda v: np.clip(v, low, high)
        gain_of = lambda gg, hh, v: -(gg * v + 0.5 * (hh + l2) * v * v)
        own = gain_of(gs, hs, clip(-gs / (hs + l2)))
        found = (1e-6, None)
        for k in range(width):
            if not len(edges[k]):
                continue
            gl = np.cumsum(np.bincount(codes[rows, k], g[rows], len(edges[k]) + 1))[:-1]
            hl = np.cumsum(np.bincount(codes[rows, k], h[rows], len(edges[k]) + 1))[:-1]
            vl, vr = clip(-gl / (hl + l2)), clip(-(gs - gl) / (hs - hl + l2))
            ok = (hl >= least) & (hs - hl >= least)
            if monotone[k]:
                ok &= monotone[k] * (vr - vl) >= 0
            gain = np.where(ok, gain_of(gl, hl, vl) + gain_of(gs - gl, hs - hl, vr) - own, -np.inf)
            at = int(gain.argmax())
            if gain[at] > found[0]:
                found = (float(gain[at]), (k, at, float(vl[at]), float(vr[at])))
        return found[1]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
        nodes.append([-1, 0.0, me, me, rate * value])
        split = best_split(rows, g, h, low, high) if level < depth else None
        if split is None:
            margin[rows] += rate * value
            return me
        k, at, vl, vr = split
        left = codes[rows, k] <= at
        middle = (vl + vr) / 2
        a, b = ((low, middle), (middle, high)) if monotone[k] > 0 else ((middle, high), (low, middle)) if monotone[k] < 0 else ((low, high), (low, high))
        nodes[me][:4] = [k, float(edges[k][at]), grow(rows[left], g, h, level + 1, *a), grow(rows[~left], g, h, level + 1, *b)]
        return me

    for _ in range(trees if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
    a = np.array(nodes, float).reshape(-1, 5)
    return Forest(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots, np.int32), depth, base)
