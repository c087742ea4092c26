"""Logistic regression for small feature tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -8, 8) @ self.weights + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
    """y from 0 to 1. Without rows, or with one class, the result is the smoothed share."""
    n, d = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    center = x.mean(axis=0) if n else np.zeros(d)
    scale = np.where((s := x.std(axis=0) if n else np.ones(d)) > 1e-9, s, 1.0)
    model = Logistic(center, scale, np.zeros(d), float(np.log(prior / (1 - prior))))
    if n < 2 or y.min() == y.max():
        return model
    z = np.hstack([np.clip((x - center) / scale, -8, 8), np.ones((n, 1))])
    w = np.append(model.weights, model.bias)
    penalty = np.append(np.full(d, ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        hessian = (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + np.diag(penalty)
        change = np.linalg.solve(hessian, gradient)
        w -= change * min(1.0, 5.0 / (np.abs(change).max() + 1e-12))
        if np.abs(change).max() < 1e-6:
            break
    model.weights, model.bias = w[:-1], float(w[-1])
    return model
