"""Gradient-boosted regression trees with logistic loss in numpy, for a bounded number of rows."""

from __future__ import annotations

import numpy as np

BINS = 32


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> dict:
    """Complete binary trees of the given depth; a node splits at the quantile edge of the largest gain."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    score, inner = np.full(len(y), start), 2**depth - 1
    model = {"start": start, "feature": [], "edge": [], "leaf": [], "depth": depth}
    for _ in range(trees):
        p = 0.5 * (1 + np.tanh(score / 2))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node, feature, edge = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            place = np.zeros(width, np.int64)
            for f in range(len(edges)):
                if not len(edges[f]):
                    continue
                at, size = (node - first) * (BINS + 1) + binned[f], width * (BINS + 1)
                gs = np.bincount(at, g, size).reshape(width, -1).cumsum(axis=1)
                hs = np.bincount(at, h, size).reshape(width, -1).cumsum(axis=1)
                all_g, all_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (all_g - gs) ** 2 / (all_h - hs + l2) - all_g**2 / (all_h + l2)
                gain = gain[:, : len(edges[f])]
                k = gain.argmax(axis=1)
                for n in np.flatnonzero(gain[np.arange(width), k] > best):
                    best[n], place[n] = gain[n, k[n]], k[n]
                    feature[first + n], edge[first + n] = f, edges[f][k[n]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > edge[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        score += value[leaf]
        for name, v in (("feature", feature), ("edge", edge), ("leaf", value)):
            model[name].append(v)
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of each row."""
    score, rows = np.full(len(x), model["start"]), np.arange(len(x))
    for feature, edge, leaf in zip(model["feature"], model["edge"], model["leaf"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > edge[node])
        score += leaf[node - len(edge)]
    return 0.5 * (1 + np.tanh(score / 2))
