"""Gradient-boosted regression trees on the logistic loss, for small samples of numeric features."""

from __future__ import annotations

import numpy as np

from skylark.llm.linear import sigmoid


class Boosted:
    """Trees of a fixed depth over quantile bins. Each tree is a full binary one, kept as arrays of features and limits by level."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24, shrink: float = 1.0):
        self.depth, self.features, self.limits, self.leaves = depth, [], [], []
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1) if len(x) else np.zeros(x.shape, int)
        odds = np.full(len(y), self.base)
        for _ in range(trees if len(y) else 0):
            p = sigmoid(odds)
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node, feature, limit = np.zeros(len(y), int), [], []
            for level in range(depth):
                gains = []
                for f, e in enumerate(edges):
                    size = len(e) + 1
                    at = node * size + codes[:, f]
                    gs, hs = (np.bincount(at, v, minlength=size << level).reshape(-1, size) for v in (g, h))
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + shrink) + (gt - gl) ** 2 / (ht - hl + shrink) - gt**2 / (ht + shrink)
                    best = gain.argmax(1) if size > 1 else np.zeros(len(gt), int)
                    gains.append((gain.max(1) if size > 1 else np.zeros(len(gt)), best))
                pick = np.array([g_ for g_, _ in gains]).argmax(0)
                cut = np.array([gains[f][1][k] for k, f in enumerate(pick)])
                feature.append(pick)
                limit.append(np.array([edges[f][c] if len(edges[f]) else np.inf for f, c in zip(pick, cut, strict=True)]))
                node = 2 * node + (codes[np.arange(len(y)), pick[node]] > cut[node])
            leaf = -rate * np.bincount(node, g, minlength=1 << depth) / (np.bincount(node, h, minlength=1 << depth) + shrink)
            odds += leaf[node]
            self.features.append(feature)
            self.limits.append(limit)
            self.leaves.append(leaf)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            node = np.zeros(len(x), int)
            for f, c in zip(feature, limit, strict=True):
                node = 2 * node + (x[rows, f[node]] > c[node])
            out += leaf[node]
        return out
