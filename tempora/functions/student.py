"""Quantiles of Student's t, by Newton steps on the tail that the incomplete beta function gives."""

from __future__ import annotations

import math

import numpy as np


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function for x in 0 .. 1, by its continued fraction (of the side that converges fast)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    total = d.copy()
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total *= c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return np.where(turn, 1 - front * total, front * total)


def quantile(df: np.ndarray, p: float = 0.975) -> np.ndarray:
    """The t that p of the distribution lies below, for p above a half and any degrees of freedom above 0; NaN for others.

    The tail is convex there, so that Newton steps from below the root go up to it and nowhere else.
    """
    if not 0.5 < p < 1:
        raise ValueError("p must lie between a half and 1")
    df = np.asarray(df, float)
    good = np.isfinite(df) & (df > 0)
    v = np.where(good, df, 1.0)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    scale = np.exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / np.sqrt(v * math.pi)
    t = np.zeros_like(v)
    for _ in range(200):
        tail = incomplete_beta(v / 2, 0.5, v / (v + t * t)) / 2
        step = (tail - (1 - p)) / (scale * (1 + t * t / v) ** (-(v + 1) / 2))
        t = t + step
        if np.all(np.abs(step) <= 1e-13 * np.maximum(1, t)):
            break
    return np.where(good, t, np.nan)
