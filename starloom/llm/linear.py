"""Small linear models, fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def linear_svm(wide: np.ndarray, signs: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear support vector machine: squared hinge loss by accelerated gradient steps.

    ``wide`` has a row for each example and a last column of ones. Classes weigh the same whatever their number of rows.
    """
    kind = wide.dtype.type
    signs = signs.astype(kind)
    share = np.where(signs > 0, 0.5 / max((signs > 0).sum(), 1), 0.5 / max((signs <= 0).sum(), 1)).astype(kind)
    # Largest curvature of the loss, by a few power iterations.
    probe = np.ones(wide.shape[1], kind) / kind(np.sqrt(wide.shape[1]))
    bound = 1.0
    for _ in range(20):
        probe = wide.T @ (share * (wide @ probe))
        bound = max(float(np.linalg.norm(probe)), 1e-12)
        probe /= kind(bound)
    rate = kind(1 / (2 * 1.1 * bound + penalty))
    w = ahead = np.zeros(wide.shape[1], kind)
    for step in range(steps):
        slack = np.maximum(0, 1 - signs * (wide @ ahead))
        # Twice the factor, not twice the matrix, which would be copied.
        grad = wide.T @ (-2 * (share * signs * slack))
        grad[:-1] += kind(penalty) * ahead[:-1]
        new = ahead - rate * grad
        ahead, w = new + (new - w) * kind(step / (step + 3)), new
    return w[:-1], float(w[-1])


def logistic(rows: np.ndarray, labels: np.ndarray, penalty: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression, the offset last: Newton steps. Every row weighs the same, so scores are calibrated."""
    wide = np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
    w = np.zeros(wide.shape[1])
    ridge = np.full(wide.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = probability(wide @ w)
        hess = (wide * (p * (1 - p) + 1e-9)[:, None]).T @ wide / len(rows) + np.diag(ridge)
        move = np.linalg.solve(hess, wide.T @ (p - labels) / len(rows) + ridge * w)
        w -= move * min(1.0, 5 / max(float(np.abs(move).max()), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
