"""Gradient-boosted trees on dense features, and isotonic calibration; small models fitted from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees of equal depth as flat arrays: node i has children 2 i + 1 and 2 i + 2."""

    start: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        inner = self.features.shape[1] if len(self.features) else 0
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: float = 4.0) -> Boosted:
    """Logistic loss, second-order splits on quantile bins; each tree is grown level by level to its full depth."""
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
    start, inner = float(np.log(share / (1 - share))), 2**depth - 1
    none = Boosted(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    margin, all_features, all_cuts, all_leaves = np.full(len(y), start), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        features, cuts, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gain = np.zeros(count)
            at = node - first
            g_all, h_all = np.bincount(at, grad, count), np.bincount(at, hess, count)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                width = len(e) + 1
                cell = at * width + codes[:, f]
                g = np.cumsum(np.bincount(cell, grad, count * width).reshape(count, width), axis=1)[:, :-1]
                h = np.cumsum(np.bincount(cell, hess, count * width).reshape(count, width), axis=1)[:, :-1]
                other_g, other_h = g_all[:, None] - g, h_all[:, None] - h
                score = g**2 / (h + l2) + other_g**2 / (other_h + l2) - (g_all**2 / (h_all + l2))[:, None]
                score[(h < least) | (other_h < least)] = -np.inf
                best = score.argmax(axis=1)
                value = score[np.arange(count), best]
                better = value > gain
                gain[better] = value[better]
                features[first : first + count][better] = f
                cuts[first : first + count][better] = e[best[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), features[node]] > cuts[node])
        at = node - inner
        leaves = -rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + l2)
        margin += leaves[at]
        all_features.append(features), all_cuts.append(cuts), all_leaves.append(leaves)
    return Boosted(start, np.array(all_features), np.array(all_cuts), np.array(all_leaves))


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing map from margin to probability (pool adjacent violators, one more success and failure)."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of margins, sum of labels, size
    for m, v in zip(margin[order].tolist(), y[order].tolist()):
        blocks.append([m, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    share = float(y.mean()) if len(y) else 0.0
    knots = np.array([b[0] / b[2] for b in blocks] or [0.0])
    values = np.array([(b[1] + share) / (b[2] + 1) for b in blocks] or [share])
    return knots, np.maximum.accumulate(values)


def calibrated(margin: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(margin, knots, values), 0.0, 1.0)
