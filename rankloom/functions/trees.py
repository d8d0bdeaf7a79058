"""Bagged decision trees in numpy: trained on a bounded sample on the driver, applied to Arrow batches on the executors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Trees as flat arrays (tree, node): feature (-1 at a leaf), threshold, left child, and class shares at the node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    shares: np.ndarray
    depth: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean class shares over the trees: (rows, classes)."""
        out = np.zeros((len(x), self.shares.shape[2]))
        rows = np.arange(len(x))
        for f, t, lo, p in zip(self.feature, self.threshold, self.left, self.shares):
            at = np.zeros(len(x), dtype=np.int32)
            for _ in range(self.depth):
                g = f[at]
                inner = g >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(g, 0)] > t[at]
                at = np.where(inner, lo[at] + right, at)
            out += p[at]
        return out / len(self.feature)


def train(x: np.ndarray, y: np.ndarray, classes: int, trees: int = 24, depth: int = 8, least: int = 4, share: float = 1.0, seed: int = 7) -> Forest:
    """Trees on bootstraps of the rows; each split looks at a ``share`` of the features, cut at quantiles.

    All nodes of a level are split at once from histograms of (node, bin, class).
    """
    rng = np.random.default_rng(seed)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    most = 2 ** (depth + 1)
    feature, left = np.full((trees, most), -1, dtype=np.int16), np.zeros((trees, most), dtype=np.int32)
    threshold, shares = np.zeros((trees, most)), np.zeros((trees, most, classes))
    for k in range(trees):
        weight = np.bincount(rng.integers(0, n, n), minlength=n).astype(float)
        node = np.zeros(n, dtype=np.int64)
        used, level = 1, np.array([0])
        for d in range(depth + 1):
            place = np.full(most, -1)
            place[level] = np.arange(len(level))
            own = place[node]
            live = np.flatnonzero((own >= 0) & (weight > 0))
            count = np.bincount(own[live] * classes + y[live], weights=weight[live], minlength=len(level) * classes).reshape(-1, classes)
            total = count.sum(axis=1)
            shares[k, level] = count / np.maximum(total, 1e-9)[:, None]
            if d == depth:
                break
            gain, best = np.full(len(level), 1e-9), np.full((len(level), 2), -1)
            impurity = total - (count**2).sum(axis=1) / np.maximum(total, 1e-9)
            asked = rng.permutation(m)[: max(1, round(share * m))] if share < 1 else range(m)
            for j in asked:
                h = np.bincount((own[live] * BINS + codes[live, j]) * classes + y[live], weights=weight[live], minlength=len(level) * BINS * classes).reshape(len(level), BINS, classes)
                a = h.cumsum(axis=1)[:, :-1]
                b = count[:, None] - a
                na, nb = a.sum(axis=2), b.sum(axis=2)
                after = na - (a**2).sum(axis=2) / np.maximum(na, 1e-9) + nb - (b**2).sum(axis=2) / np.maximum(nb, 1e-9)
                g = np.where((na >= least) & (nb >= least), impurity[:, None] - after, -1)
                at = g.argmax(axis=1)
                top = g[np.arange(len(level)), at]
                better = (top > gain) & (at < len(cuts[j]))
                gain[better], best[better, 0], best[better, 1] = top[better], j, at[better]
            split = np.flatnonzero(best[:, 0] >= 0)
            if not len(split):
                break
            parents = level[split]
            feature[k, parents] = best[split, 0]
            threshold[k, parents] = [cuts[j][c] for j, c in best[split]]
            left[k, parents] = used + 2 * np.arange(len(split))
            moved = np.flatnonzero((own >= 0) & (feature[k, node] >= 0))
            f = feature[k, node[moved]]
            node[moved] = left[k, node[moved]] + (x[moved, f] > threshold[k, node[moved]])
            level = used + np.arange(2 * len(split))
            used += 2 * len(split)
    return Forest(feature, threshold, left, shares, depth)
