"""Gradient-boosted trees for a yes/no target over small whole-number features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Trees:
    """Complete trees: node ``i`` asks whether ``x[feature] > cut`` and goes on to ``2 i + 1`` or ``2 i + 2``."""

    features: np.ndarray    # trees x inner nodes
    cuts: np.ndarray
    leaves: np.ndarray      # trees x leaves
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(self.leaves.shape[1]).bit_length() - 1
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; splits by histograms over at most BINS values per feature."""
    x = np.clip(x, 0, BINS - 1).astype(np.int64)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    inner, n_features = (1 << depth) - 1, x.shape[1]
    all_f, all_c, all_l = (np.zeros((trees, n), k) for n, k in ((inner, np.int64), (inner, np.int64), (inner + 1, np.float64)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        all_c[t] = BINS     # no split: all go left
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            cells = at * BINS
            best = np.full(width, 1e-6)
            for f in range(n_features):
                key = cells + x[:, f]
                g = np.bincount(key, grad, width * BINS).reshape(width, BINS)
                h = np.bincount(key, hess, width * BINS).reshape(width, BINS)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gr, hr = gt - gl, ht - hl
                gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1) - gt**2 / (ht + 1), 0)
                cut = gain.argmax(1)
                top = gain[np.arange(width), cut]
                better = top > best
                all_f[t, first : first + width][better] = f
                all_c[t, first : first + width][better] = cut[better]
                best = np.where(better, top, best)
            node = 2 * node + 1 + (x[np.arange(len(y)), all_f[t, node]] > all_c[t, node])
        leaf = node - inner
        all_l[t] = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + 1)
        margin += all_l[t, leaf]
    return Trees(all_f, all_c, all_l, start)


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset that turn margins of held-out rows into probabilities (logistic fit by Newton steps)."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - y) * margin).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margin**2).sum() + 1e-2, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
