"""Test statistics that need no library: chi-square tails, Fisher's exact test, adjustments, quantiles."""

from __future__ import annotations

import math

import numpy as np


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution."""
    if x <= 0 or df < 1:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:  # series of the lower part
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - front * total)
    b = z + 1 - a  # continued fraction of the upper part
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi_square(table: np.ndarray) -> tuple[float | None, int, float | None, float]:
    """Statistic (no continuity correction), degrees of freedom, p, least expected count; None where a margin is 0."""
    expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0, keepdims=True) / table.sum()
    df = (table.shape[0] - 1) * (table.shape[1] - 1)
    if (expected == 0).any():
        return None, df, None, 0.0
    x = float(((table - expected) ** 2 / expected).sum())
    return x, df, chi2_sf(x, df), float(expected.min())


def fisher(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Sample odds ratio and two-sided p of a 2 by 2 table."""
    row, col, n = a + b, a + c, a + b + c + d
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    log = lambda k: choose(col, k) + choose(n - col, row - k) - choose(n, row)
    here = log(a)
    p = sum(math.exp(log(k)) for k in range(max(0, row + col - n), min(row, col) + 1) if log(k) <= here + 1e-7)
    odds = math.inf if b * c == 0 and a * d > 0 else math.nan if b * c == 0 else a * d / (b * c)
    return odds, min(1.0, p)


def quantile_weibull(x: np.ndarray, p: float) -> float:
    """The quantile at (n + 1) p, interpolated and held within the data."""
    x = np.sort(np.asarray(x, float))
    h = min(max((len(x) + 1) * p, 1), len(x))
    k = int(math.floor(h))
    return float(x[k - 1] + (h - k) * (x[min(k, len(x) - 1)] - x[k - 1]))
