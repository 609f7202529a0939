"""Least squares with non-negative coefficients, by active sets, from sums of products alone."""

from __future__ import annotations

import numpy as np


def nnls(a: np.ndarray, y: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimizes |a x - y|; missing numbers count as 0."""
    a, y = np.nan_to_num(np.asarray(a, dtype=np.float64)), np.nan_to_num(np.asarray(y, dtype=np.float64))
    return nnls_of_sums(a.T @ a, a.T @ y, rounds)


def nnls_of_sums(gram: np.ndarray, right: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """The same from the products of the columns with each other and with y. The set of free coefficients grows by the
    steepest one."""
    n = len(right)
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-10 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds or 3 * n + 10):
        slope = right - gram @ x
        slope[free] = -np.inf
        if free.all() or slope.max(initial=-np.inf) <= tolerance:
            break
        free[int(np.argmax(slope))] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(gram[np.ix_(free, free)], right[free], rcond=None)[0]
            low = free & (trial <= 0)
            if not low.any():
                x = trial
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = x + step * (trial - x)
            free &= x > tolerance * 1e-6
            x[~free] = 0
            if not free.any():
                break
    return x
