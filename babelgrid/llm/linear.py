"""Logistic regression in numpy, for models small enough to fit on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, weight: np.ndarray | None = None,
              steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps on a dense matrix; the intercept is not penalised."""
    n, p = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    w = np.zeros(p + 1)
    s = np.ones(n) if weight is None else weight
    pen = np.r_[np.full(p, l2 * s.sum()), 1e-9]
    for _ in range(steps):
        q = sigmoid(a @ w)
        grad = a.T @ (s * (q - y)) + pen * w
        h = (a * (s * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ a + np.diag(pen)
        step = np.linalg.solve(h, grad)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_sparse(rows: list[np.ndarray], value: np.ndarray, y: np.ndarray, l2: float, steps: int = 400
               ) -> tuple[np.ndarray, float]:
    """Adam on rows of feature numbers; feature j has the value ``value[j]`` where present."""
    sizes = np.array([len(r) for r in rows])
    cols = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    w = np.zeros(len(value) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[cols] * value[cols], len(rows)) + w[-1]
        e = (sigmoid(z) - y) / max(1, len(y))
        g = np.r_[np.bincount(cols, e[doc] * value[cols], len(value)) + l2 * w[:-1], e.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w[:-1], float(w[-1])
