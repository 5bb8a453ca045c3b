"""Gradient-boosted trees for two classes, over binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS, DEPTH, TREES, RATE, L2, MIN_HESS = 32, 4, 60, 0.2, 1.0, 2.0


class Trees:
    """Complete trees of DEPTH levels; a row goes right where its feature exceeds the node's cut."""

    def __init__(self, start: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> None:
        self.start, self.feature, self.cut, self.leaf = start, feature, cut, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class one for each row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
    """Boost on the logistic loss; each level takes the best cut of each node over all features."""
    n = len(x)
    w = np.ones(n) if weight is None else weight
    two = ((x == 0) | (x == 1)).all(axis=0)  # yes-or-no features need one cut and no bins
    many, flags = np.flatnonzero(~two), np.flatnonzero(two)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in many]
    binned = [np.searchsorted(e, x[:, j], "left") for j, e in zip(many, edges)]
    cut_at = np.full((len(many), BINS), np.inf)
    for i, e in enumerate(edges):
        cut_at[i, : len(e)] = e
    yes = np.ascontiguousarray(x[:, flags].T)
    share = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    inner = 2**DEPTH - 1
    features, cuts, leaves = [], [], []

    def gains(g, h, g_all, h_all):
        """What a cut gains, g and h being the sums at or below it; 0 where a side is too light."""
        gain = g**2 / (h + L2) + (g_all - g) ** 2 / (h_all - h + L2) - g_all**2 / (h_all + L2)
        return np.where((h < MIN_HESS) | (h_all - h < MIN_HESS), 0, gain)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        both = np.stack([w * (y - p), w * p * (1 - p)])  # gradient and curvature
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            slot = at - first
            spread = np.zeros((n, nodes, 2))
            spread[np.arange(n), slot] = both.T
            total = spread.sum(axis=0)
            no = total[None] - (yes @ spread.reshape(n, -1)).reshape(len(flags), nodes, 2)
            of_flags = gains(no[..., 0], no[..., 1], total[None, :, 0], total[None, :, 1])
            size = nodes * BINS
            sums = np.array([[np.bincount(slot * BINS + b, v, size) for v in both] for b in binned]).reshape(len(many), 2, nodes, BINS).cumsum(axis=3)
            of_many = gains(sums[:, 0], sums[:, 1], total[None, :, 0, None], total[None, :, 1, None])
            of_many[np.isinf(cut_at)[:, None].repeat(nodes, axis=1)] = 0
            for node in range(nodes):
                j = int(of_flags[:, node].argmax()) if len(flags) else -1
                i, b = divmod(int(of_many[:, node].argmax()), BINS) if len(many) else (-1, 0)
                best_flag, best_many = of_flags[j, node] if j >= 0 else 0, of_many[i, node, b] if i >= 0 else 0
                if max(best_flag, best_many) > 1e-6:
                    feature[first + node] = flags[j] if best_flag >= best_many else many[i]
                    cut[first + node] = 0.5 if best_flag >= best_many else cut_at[i, b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf_of = at - inner
        g, h = (np.bincount(leaf_of, v, 2**DEPTH) for v in both)
        leaf = RATE * g / (h + L2)
        margin += leaf[leaf_of]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(start, np.array(features), np.array(cuts), np.array(leaves))
