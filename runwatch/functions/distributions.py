"""Inverse distribution functions, evaluated once per model on the driver or
inside the per-operating-point step.  Only scalars go in and out."""

from __future__ import annotations

import math
from statistics import NormalDist

_TINY = 1e-300


def normal_quantile(q: float) -> float:
    return NormalDist().inv_cdf(q)


def _lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function P(a, x)."""
    if x <= 0.0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return min(1.0, total * front)
    # modified Lentz continued fraction for the upper tail
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-16:
            break
    return 1.0 - front * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1.0)) or _TINY)
    h = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / ((1.0 + even * d) or _TINY)
        c = (1.0 + even / c) or _TINY
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + odd * d) or _TINY)
        c = (1.0 + odd / c) or _TINY
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-16:
            break
    return h


def _beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _bisect(cdf, q: float, hi: float) -> float:
    lo = 0.0
    while cdf(hi) < q:
        hi *= 2.0
    for _ in range(400):
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        if cdf(mid) < q:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def chi2_quantile(q: float, df: float) -> float:
    return _bisect(lambda x: _lower_gamma(df / 2.0, x / 2.0), q, max(df, 1.0))


def f_quantile(q: float, d1: float, d2: float) -> float:
    return _bisect(lambda x: _beta_cdf(d1 / 2.0, d2 / 2.0, d1 * x / (d1 * x + d2)), q, 2.0)
