"""Weighted L2 logistic regression in numpy, for data that one task holds."""

from __future__ import annotations

import numpy as np


def _loss(beta: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float, k: int) -> tuple[float, np.ndarray]:
    """C * sum of weighted losses + half the squared norm of the coefficients (not of the intercepts), and its gradient."""
    b = beta.reshape(-1, x.shape[1] + 1)
    s = x @ b[:, :-1].T + b[:, -1]
    if k == 2:
        s = s[:, 0]
        value = np.logaddexp(0, np.where(y == 1, -s, s))
        g = (1 / (1 + np.exp(-np.clip(s, -500, 500))) - y)[:, None]
    else:
        top = s.max(1, keepdims=True)
        e = np.exp(s - top)
        total = e.sum(1, keepdims=True)
        value = (np.log(total) + top)[:, 0] - s[np.arange(len(y)), y]
        g = e / total
        g[np.arange(len(y)), y] -= 1
    g = c * g * w[:, None]
    out = np.concatenate([g.T @ x + b[:, :-1], g.sum(0)[:, None]], 1)
    return c * float(w @ value) + 0.5 * float((b[:, :-1] ** 2).sum()), out.ravel()


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, c: float, max_iter: int = 1000, tol: float = 1e-7, memory: int = 12) -> np.ndarray:
    """Coefficients and intercepts (rows: one for two classes, else one a class) by limited-memory BFGS."""
    beta = np.zeros((1 if k == 2 else k) * (x.shape[1] + 1))
    value, grad = _loss(beta, x, y, w, c, k)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        if np.abs(grad).max() <= tol:
            break
        d, used = -grad, []
        for s, t, r in reversed(steps):
            a = r * (s @ d)
            used.append(a)
            d = d - a * t
        if steps:
            s, t, r = steps[-1]
            d = d / (r * (t @ t))
        for (s, t, r), a in zip(steps, reversed(used), strict=True):
            d = d + (a - r * (t @ d)) * s
        slope, size = float(grad @ d), 1.0 if steps else min(1.0, 1 / np.abs(grad).sum())
        while True:
            new_value, new_grad = _loss(beta + size * d, x, y, w, c, k)
            if new_value <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        if size < 1e-10:  # no step lowers the loss any more: as exact as floating point allows
            break
        s, t = size * d, new_grad - grad
        if s @ t > 1e-14:
            steps = [*steps[-(memory - 1) :], (s, t, 1 / float(s @ t))]
        beta, value, grad = beta + s, new_value, new_grad
    return beta.reshape(-1, x.shape[1] + 1)


def probabilities(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    s = x @ beta[:, :-1].T + beta[:, -1]
    if len(beta) == 1:
        p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
        return np.concatenate([1 - p, p], 1)
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
