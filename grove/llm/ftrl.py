"""Logistic regression over hashed features, trained with follow-the-regularised-leader updates; scores are sparse dots."""

from __future__ import annotations

import numpy as np


class FTRL:
    """Per-coordinate FTRL-proximal. The bias is not regularised. rising: no weight below zero."""

    def __init__(self, bits: int, alpha: float, beta: float = 1.0, l1: float = 1.0, l2: float = 0.1, rising: bool = False) -> None:
        self.alpha, self.beta, self.l1, self.l2, self.rising = alpha, beta, l1, l2, rising
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where((z < -self.l1) if self.rising else (np.abs(z) > self.l1), w, 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """at: distinct features of one example; x: their values."""
        at, x = at.astype(np.int64), x.astype(np.float64)
        w = self.weights(at)
        bias = -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)
        p = 1 / (1 + np.exp(-np.clip(bias + w @ x, -35, 35)))
        for i, v, u in ((at, x, w), (-1, 1.0, bias)):
            g = (p - y) * v
            n = self.n[i]
            self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * u
            self.n[i] = n + g * g

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
        """Weights of all features, and the bias."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(examples)):
                self.update(*examples[i])
        bias = -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)
        return self.weights(slice(0, -1)).astype(np.float32), float(bias)


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))
