"""Gradient-boosted trees for two classes: logistic loss, Newton steps, histograms of quantile bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: per tree and inner node a feature and a threshold (go right if above), per leaf a value."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - len(f)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> Trees:
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    margin = np.full(n, np.log(share / (1 - share)))
    prior, features, thresholds, leaves = margin[0], [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.zeros(nodes)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = (at - first) * bins + binned[:, j]
                left = [np.cumsum(np.bincount(cell, w, nodes * bins).reshape(nodes, bins), axis=1) for w in (g, h)]
                (gl, hl), (gt, ht) = left, (s[:, -1:] for s in left)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                k = gain[:, : len(c)].argmax(1)
                won = gain[np.arange(nodes), k]
                take = won > best + 1e-9
                best[take] = won[take]
                f[first : first + nodes][take] = j
                t[first : first + nodes][take] = c[k[take]]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        margin += value[leaf]
        features.append(f)
        thresholds.append(t)
        leaves.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), float(prior))
