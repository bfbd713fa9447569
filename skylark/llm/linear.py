"""Small linear models that are fitted on bounded samples and then applied by every task."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), x.dtype)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the intercept, which isn't shrunk."""
    x = with_one(x.astype(np.float64))
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(shrink), x.T @ (p - y) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 30, seed: int = 0) -> np.ndarray:
    """Weights (the last is the intercept) of a linear support vector machine, y being -1 or 1, by dual coordinate ascent on the hinge loss."""
    x = with_one(x.astype(np.float32))
    alpha, w, norms = np.zeros(len(x)), np.zeros(x.shape[1]), np.einsum("ij,ij->i", x, x)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norms[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved, alpha[i] = max(moved, abs(new - alpha[i])), new
        if moved < 1e-3 * c:
            break
    return w


def folds(n: int, k: int) -> np.ndarray:
    """Fold of each of n rows, in a fixed mixed order."""
    return np.random.default_rng(0).permutation(n) % k
