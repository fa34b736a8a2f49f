"""Gradient-boosted trees on yes/no features, fitted on counts.

The rows of the training table are distinct feature codes with how often each label was
seen, so its size does not grow with the corpus.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 40
RATE = 0.3
PENALTY = 1.0
DEPTH = 2


class Trees:
    """Sum of small trees; ``score`` gives the log-odds of a code."""

    def __init__(self, n_features: int):
        self.n_features, self.trees, self.start = n_features, [], 0.0

    def _bits(self, codes) -> np.ndarray:
        codes = np.asarray(codes, dtype=np.int64)
        return (codes[:, None] >> np.arange(self.n_features)) & 1 == 1

    def _grow(self, bits, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if depth:
            for f in range(self.n_features):
                on = rows & bits[:, f]
                g1, h1 = grad[on].sum(), hess[on].sum()
                gain = g1**2 / (h1 + PENALTY) + (g - g1) ** 2 / (h - h1 + PENALTY) - g**2 / (h + PENALTY)
                best = max(best, (gain, f), key=lambda x: x[0])
        f = best[1]
        if f is None:
            return RATE * g / (h + PENALTY)
        on = self._grow(bits, grad, hess, rows & bits[:, f], depth - 1)
        off = self._grow(bits, grad, hess, rows & ~bits[:, f], depth - 1)
        return f, on, off

    def _value(self, tree, bits) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(bits), tree)
        f, on, off = tree
        return np.where(bits[:, f], self._value(on, bits), self._value(off, bits))

    def fit(self, codes, yes, no) -> Trees:
        bits = self._bits(codes)
        yes, no = np.asarray(yes, float), np.asarray(no, float)
        weight = yes + no
        self.start = float(np.log((yes.sum() + 1) / (no.sum() + 1)))
        score = np.full(len(bits), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(bits, yes - weight * p, weight * p * (1 - p), np.ones(len(bits), bool), DEPTH)
            self.trees.append(tree)
            score += self._value(tree, bits)
        return self

    def score(self, codes) -> np.ndarray:
        bits = self._bits(codes)
        return self.start + sum((self._value(t, bits) for t in self.trees), np.zeros(len(bits)))
