"""Gradient-boosted trees on a bounded sample, isotonic calibration and lasso logistic
regression, in numpy.  All are deterministic and take any labels, one class or none."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Tree:
    """feature < 0 marks a leaf; a row goes left where its feature <= threshold."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            a.append(v)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, t, lo, hi, v = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right, self.value))
        at = np.zeros(len(x), np.int64)
        while (inner := f[at] >= 0).any():
            k = np.flatnonzero(inner)
            go = x[k, f[at[k]]] <= t[at[k]]
            at[k] = np.where(go, lo[at[k]], hi[at[k]])
        return v[at]


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.predict(x)
        return out


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 10, l2: float = 1.0, bins: int = 64) -> Boosted:
    """Logistic boosting with histogram splits; leaves hold at least ``least`` rows."""
    n = len(y)
    p = (y.sum() + 0.5) / (n + 1)
    model = Boosted(float(np.log(p / (1 - p))), rate, [])
    if n < 2 * least or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    margin = np.full(n, model.base)
    for _ in range(n_trees):
        q = sigmoid(margin)
        g, h = q - y, q * (1 - q)
        tree, open_ = Tree(), {}
        open_[tree.add()] = np.arange(n)
        for level in range(depth + 1):
            below = {}
            for node, rows in open_.items():
                gs, hs = g[rows].sum(), h[rows].sum()
                tree.value[node] = float(-gs / (hs + l2))
                if level == depth or len(rows) < 2 * least:
                    continue
                best = (1e-6, -1, 0)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0] + 1e-12:
                        best = (float(gain[k]), j, k)
                if best[1] >= 0:
                    _, j, k = best
                    tree.feature[node], tree.threshold[node] = j, float(edges[j][k])
                    tree.left[node], tree.right[node] = tree.add(), tree.add()
                    go = binned[rows, j] <= k
                    below[tree.left[node]], below[tree.right[node]] = rows[go], rows[~go]
            open_ = below
        model.trees.append(tree)
        margin += rate * tree.predict(x)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (scores, rising values) to interpolate between."""
    if not len(y):
        return np.zeros(1), np.full(1, 0.5)
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order].astype(float)
    sums: list[float] = []
    sizes: list[int] = []
    middles: list[float] = []
    for a, b in zip(s, v, strict=True):
        sums.append(b)
        sizes.append(1)
        middles.append(a)
        while len(sums) > 1 and sums[-2] / sizes[-2] >= sums[-1] / sizes[-1]:
            n = sizes[-2] + sizes[-1]
            middles[-2] = (middles[-2] * sizes[-2] + middles[-1] * sizes[-1]) / n
            sums[-2] += sums[-1]
            sizes[-2] = n
            sums.pop(), sizes.pop(), middles.pop()
    return np.array(middles), (np.array(sums) + 0.5 * y.mean()) / (np.array(sizes) + 0.5)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient steps."""
    n, m = x.shape
    p = (y.sum() + 0.5) / (n + 1)
    b, w = float(np.log(p / (1 - p))), np.zeros(m)
    if not n or not m or y.min() == y.max():
        return b, w
    v = np.ones(m)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (0.25 * (np.linalg.norm(x @ v) ** 2 / n + 1) + 1e-9)
    zb, zw, t = b, w.copy(), 1.0
    for _ in range(rounds):
        r = sigmoid(zb + x @ zw) - y
        nb = zb - step * r.mean()
        nw = zw - step * (x.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zb, zw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b, w
