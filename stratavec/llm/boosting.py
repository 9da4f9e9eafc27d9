"""Gradient-boosted trees for log loss on binned features, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of a fixed depth, stored as complete trees of (feature, threshold) and leaf values."""

    def __init__(self, depth: int = 3, rounds: int = 80, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> None:
        self.depth, self.rounds, self.rate, self.ridge, self.least = depth, rounds, rate, ridge, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature = np.zeros(2**self.depth - 1, np.int64)
            threshold = np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-9)
                chosen = [(0, -1)] * n
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    slot = node * BINS + binned[:, j]
                    gs, hs = (np.bincount(slot, v, n * BINS).reshape(n, BINS).cumsum(1) for v in (g, h))
                    gl, hl, gt, ht = gs[:, : len(c)], hs[:, : len(c)], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hl < self.least / 10) | (ht - hl < self.least / 10)] = -1
                    k = gain.argmax(1)
                    top = gain[np.arange(n), k]
                    for i in np.flatnonzero(top > best):
                        best[i], chosen[i] = top[i], (j, int(k[i]))
                right = np.zeros(len(y), np.int64)
                for i, (j, k) in enumerate(chosen):
                    if k >= 0:
                        feature[first + i], threshold[first + i] = j, cuts[j][k]
                        mine = node == i
                        right[mine] = binned[mine, j] > k
                node = node * 2 + right
            leaves = 2**self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.trees.append((feature, threshold, value))
            f += value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > threshold[at])
            f += value[node]
        return f


class Isotonic:
    """Pooled adjacent violators: a rising step curve through labels, read with straight lines between its steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([b, 1.0, a, a])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                s, n, _, hi = blocks.pop()
                blocks[-1][0] += s
                blocks[-1][1] += n
                blocks[-1][3] = hi
        self.x = np.array([v for *_, lo, hi in blocks for v in (lo, hi)])
        self.y = np.array([(s + 0.02) / (n + 0.5) if s * 2 < n else (s + 0.48) / (n + 0.5) for s, n, *_ in blocks for _ in range(2)])
        self.y = np.maximum.accumulate(self.y) if len(self.y) else self.y

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y) if len(self.x) else 1 / (1 + np.exp(-x))
