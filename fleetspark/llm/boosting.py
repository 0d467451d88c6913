"""Gradient-boosted trees over small tables of dense features, in numpy.

Training runs on the driver over a bounded sample of labelled rows (the caller
states the bound); scoring runs anywhere, over whole columns at once, on trees
flattened into arrays of nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees. A leaf has itself as both children, so walks may overrun."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds for the rows of ``x``; missing values (nan) go left."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[rows, self.feature[node]] > self.threshold[node]
                node = np.where(right, self.right[node], self.left[node])
            total += self.value[node]
        return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, least: float = 5.0, ridge: float = 1.0, bins: int = 48, rising: tuple[int, ...] = (), falling: tuple[int, ...] = ()) -> Trees:
    """Boosted trees for 0/1 labels ``y``; deterministic.

    ``rising`` and ``falling`` list features along which the margin may only
    rise or fall: a split along one must order its leaves so, and both sides
    stay within bounds that the middle of the two sets for all splits below.
    """
    x = np.nan_to_num(np.asarray(x, float), nan=-np.inf, posinf=1e300, neginf=-1e300)
    y = np.asarray(y, float)
    mean = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    sign = np.zeros(x.shape[1])
    sign[list(rising)], sign[list(falling)] = 1, -1
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins + 1)[:-1], method="lower")) if len(c) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1) if len(cuts) else np.zeros((len(x), 0), int)
    width = max([len(c) for c in cuts], default=0) + 1
    nodes: list[list] = []
    roots = []
    margin = np.full(len(y), base)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def grow(own: np.ndarray, g: np.ndarray, h: np.ndarray, left_depth: int, low: float, high: float) -> int:
        total_g, total_h = g[own].sum(), h[own].sum()
        score = float(np.clip(-total_g / (total_h + ridge), low, high))
        best = (1e-6, None)
        if left_depth and total_h >= 2 * least:
            for f, cut in enumerate(cuts):
                if len(cut) == 0:
                    continue
                gl = np.cumsum(np.bincount(binned[own, f], g[own], width))[: len(cut)]
                hl = np.cumsum(np.bincount(binned[own, f], h[own], width))[: len(cut)]
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2) + total_g * score + 0.5 * (total_h + ridge) * score**2
                ok = (hl >= least) & (hr >= least) & (sign[f] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            margin[own] += rate * score
            return leaf(rate * score)
        f, k, vl, vr = best[1]
        middle = (vl + vr) / 2
        sides = ((low, high), (low, high))
        if sign[f] > 0:
            sides = ((low, middle), (middle, high))
        elif sign[f] < 0:
            sides = ((middle, high), (low, middle))
        goes = binned[own, f] <= k
        at = len(nodes)
        nodes.append([f, float(cuts[f][k]), 0, 0, 0.0])
        nodes[at][2] = grow(own[goes], g, h, left_depth - 1, *sides[0])
        nodes[at][3] = grow(own[~goes], g, h, left_depth - 1, *sides[1])
        return at

    for _ in range(trees if len(y) else 0):
        p = sigmoid(margin)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth, -8.0, 8.0))
    table = list(zip(*nodes, strict=True)) if nodes else [(), (), (), (), ()]
    return Trees(np.array(roots, int), np.array(table[0], int), np.array(table[1], float), np.array(table[2], int), np.array(table[3], int), np.array(table[4], float), base, depth)


@dataclass(frozen=True)
class Isotonic:
    """A rising step map from margins to probabilities, straight between its points."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
    """Pool adjacent violators over margins in order; ``prior`` pseudo rows at the mean keep ends off 0 and 1.

    Without rows of both labels the map is the sigmoid.
    """
    if len(y) == 0 or y.min() == y.max():
        at = np.linspace(-12, 12, 97)
        return Isotonic(at, sigmoid(at))
    order = np.argsort(margin, kind="stable")
    at, where = np.unique(margin[order], return_inverse=True)
    hits, many = np.bincount(where, y[order]), np.bincount(where).astype(float)
    blocks: list[list[float]] = []  # hits, rows, lowest margin, highest margin
    for h, n, m in zip(hits, many, at, strict=True):
        blocks.append([h, n, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h, n, _, top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h, blocks[-1][1] + n, blocks[-1][2], top]
    mean = float(y.mean())
    value = np.maximum.accumulate([(h + prior * mean) / (n + prior) for h, n, _, _ in blocks])
    return Isotonic(np.array([x for b in blocks for x in b[2:]]), np.repeat(value, 2))
