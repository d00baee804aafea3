"""Exact (Clopper-Pearson) limits of a binomial proportion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_PANELS, _NODES = 64, 16


def beta_quantile(a: np.ndarray, b: np.ndarray, prob: float) -> np.ndarray:
    """Quantile of Beta(a, b) for a, b >= 1, whatever their size.

    The density is integrated by Gauss-Legendre panels over 40 standard deviations around the
    mean and inverted by bisection inside the panel that holds ``prob``.  Work per row does not
    depend on the number of trials.
    """
    a, b = np.asarray(a, float)[:, None], np.asarray(b, float)[:, None]
    x, w = np.polynomial.legendre.leggauss(_NODES)
    mean = a / (a + b)
    sd = np.sqrt(mean * (1 - mean) / (a + b + 1))
    lo, hi = np.maximum(mean - 40 * sd, 0.0), np.minimum(mean + 40 * sd, 1.0)

    def density(t):
        # Relative to the mean, so that large a and b neither overflow nor lose digits.
        m = mean if t.ndim == 2 else mean[:, :, None]
        p, q = (a, b) if t.ndim == 2 else (a[:, :, None], b[:, :, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(p == 1, 0.0, (p - 1) * np.log1p((t - m) / m))
            right = np.where(q == 1, 0.0, (q - 1) * np.log1p((m - t) / (1 - m)))
        return np.exp(left + right)

    edges = lo + (hi - lo) * np.linspace(0.0, 1.0, _PANELS + 1)
    half = (edges[:, 1:] - edges[:, :-1]) / 2
    t = (edges[:, 1:] + edges[:, :-1])[:, :, None] / 2 + half[:, :, None] * x
    mass = (density(t) * w).sum(axis=2) * half
    below = np.concatenate([np.zeros_like(mean), np.cumsum(mass, axis=1)], axis=1)
    want = prob * below[:, -1:]
    panel = np.clip((below <= want).sum(axis=1, keepdims=True) - 1, 0, _PANELS - 1)
    start = np.take_along_axis(edges, panel, 1)
    left, right = start, np.take_along_axis(edges, panel + 1, 1)
    rest = want - np.take_along_axis(below, panel, 1)
    for _ in range(60):
        middle = (left + right) / 2
        h = (middle - start) / 2
        area = (density(start + h + h * x) * w).sum(axis=1, keepdims=True) * h
        left, right = np.where(area < rest, middle, left), np.where(area < rest, right, middle)
    return ((left + right) / 2)[:, 0]


def exact_interval(x: Column, n: Column, conf: float = 0.95) -> Column:
    """Struct (lower, upper) for x successes in n trials; null where n is 0."""
    tail = (1 - conf) / 2

    @F.pandas_udf("lower double, upper double")
    def limits(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        x, n = x.to_numpy(float), n.to_numpy(float)
        lower, upper = np.zeros(len(x)), np.ones(len(x))
        some, short = x > 0, x < n
        lower[some] = beta_quantile(x[some], n[some] - x[some] + 1, tail)
        upper[short] = beta_quantile(x[short] + 1, n[short] - x[short], 1 - tail)
        lower[n == 0] = upper[n == 0] = np.nan
        return pd.DataFrame({"lower": lower, "upper": upper})

    return limits(x, n)
