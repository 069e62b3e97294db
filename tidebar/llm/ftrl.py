"""Logistic regression fitted by follow-the-regularised-leader (proximal) updates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Ftrl:
    """Sparse weights over 2**bits hashed features, with an intercept."""

    def __init__(self, bits: int, alpha: float, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, positive_weight: float = 1.0, seed: int = 0) -> tuple[np.ndarray, float]:
        """Weights (float32) and intercept. ``rows``: distinct indexes and values;
        rows of label 1 count ``positive_weight`` times."""
        bias = len(self.z) - 1
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                at, x = np.append(rows[i][0], bias), np.append(rows[i][1], 1.0)
                w = self.weights(at)
                g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - labels[i]) * (positive_weight if labels[i] > 0 else 1.0) * x
                n = self.n[at]
                self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
                self.n[at] = n + g * g
        w = self.weights()
        return w[:-1].astype(np.float32), float(w[-1])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
