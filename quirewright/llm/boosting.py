"""Gradient-boosted trees for two classes, over binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of a fixed depth, stored level by level; a node sends rows with value <= cut to the left."""

    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    least: float = 1.0
    base: float = 0.0
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        x, y = np.asarray(x, float), np.asarray(y, float)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        mean = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        width = self.bins
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            feature, cut, leaf = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf), np.zeros(2**self.depth)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.zeros(n)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    at = (node - first) * width + binned[:, f]
                    g = np.bincount(at, grad, n * width).reshape(n, width).cumsum(1)
                    h = np.bincount(at, hess, n * width).reshape(n, width).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.least) + (gt - g) ** 2 / (ht - h + self.least) - gt**2 / (ht + self.least)
                    gain = gain[:, : len(e)]
                    k = gain.argmax(1)
                    value = gain[np.arange(n), k]
                    better = value > best + 1e-9
                    best[better] = value[better]
                    feature[first : first + n][better] = f
                    cut[first : first + n][better] = e[k[better]]
                right = x[np.arange(len(y)), feature[node]] > cut[node]
                node = 2 * node + 1 + right
            at = node - (2**self.depth - 1)
            g, h = np.bincount(at, grad, 2**self.depth), np.bincount(at, hess, 2**self.depth)
            leaf = -self.rate * g / (h + self.least)
            score += leaf[at]
            self.nodes.append((feature, cut, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.nodes:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))


def calibrate(p: np.ndarray, y: np.ndarray, precision: float = 0.9) -> float:
    """The threshold at which the share of true cases among the chosen reaches ``precision`` and F1 is best, midway to the next lower score."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    chosen = np.arange(1, len(p) + 1)
    prec, rec = hit / chosen, hit / max(1, y.sum())
    f1 = np.where(prec >= precision, 2 * prec * rec / np.maximum(prec + rec, 1e-9), 0)
    if not len(f1) or f1.max() <= 0:
        return 0.5
    at = int(f1.argmax())
    ranked = p[order]
    return float(ranked[at] if at + 1 == len(ranked) else (ranked[at] + ranked[at + 1]) / 2)
