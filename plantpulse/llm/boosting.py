"""Gradient-boosted trees for a yes-or-no label, small enough to be sent to every task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class BoostedTrees:
    """Trees of one depth as arrays: at each inner node the feature and the bound that sends a row right."""

    start: float
    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            while inner and at[0] < inner if len(at) else False:
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            total += leaf[at - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, ridge: float = 1.0, least: int = 5) -> BoostedTrees:
    """Newton boosting of the logistic loss over binned features; each level splits every node at its best bin."""
    bounds = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(b, column, side="left") for b, column in zip(bounds, x.T)], axis=1)
    varied = [f for f in range(x.shape[1]) if x[:, f].min() < x[:, f].max()] if len(x) else []
    width = max(map(len, bounds)) + 1
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    logit = np.full(len(y), np.log(share / (1 - share)))
    start, features, limits, leaves = float(np.log(share / (1 - share))), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        gradient, hessian = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        tree_feature, tree_bound = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best_gain, best = np.full(count, 1e-6), [None] * count
            for f in varied:
                cell = (at - first) * width + binned[:, f]
                g, h, n = (np.bincount(cell, w, count * width).reshape(count, width).cumsum(axis=1) for w in (gradient, hessian, None))
                all_g, all_h, all_n = g[:, -1:], h[:, -1:], n[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g)**2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[(n < least) | (all_n - n < least)] = 0
                gain[:, len(bounds[f]):] = 0
                at_bin = gain.argmax(axis=1)
                for node in np.flatnonzero(gain[np.arange(count), at_bin] > best_gain):
                    best_gain[node], best[node] = gain[node, at_bin[node]], (f, bounds[f][at_bin[node]])
            for node, split in enumerate(best):
                if split:
                    tree_feature[first + node], tree_bound[first + node] = split
            at = 2 * at + 1 + (x[np.arange(len(x)), tree_feature[at]] > tree_bound[at])
        cell = at - (2**depth - 1)
        leaf = rate * np.bincount(cell, gradient, 2**depth) / (np.bincount(cell, hessian, 2**depth) + ridge)
        logit += leaf[cell]
        features.append(tree_feature)
        limits.append(tree_bound)
        leaves.append(leaf)
    return BoostedTrees(start, np.stack(features), np.stack(limits), np.stack(leaves))
