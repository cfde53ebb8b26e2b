"""Tail areas and quantiles for the few numbers of a coefficient table."""

from __future__ import annotations

from math import erfc, exp, inf, lgamma, log, log1p, nan, sqrt
from statistics import NormalDist


def normal_two_sided(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t."""
    if df > 1e7:
        return normal_two_sided(t)
    a, b, t2 = df / 2, 0.5, t * t
    x = df / (df + t2)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * -log1p(t2 / df) + b * (log(t2 / (df + t2)) if t2 else -inf))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def critical(level: float, df: float = inf) -> float:
    """Two-sided critical value: Student's t, or normal for infinite ``df``; NaN without freedom."""
    if df <= 0:
        return nan
    z = NormalDist().inv_cdf(0.5 + level / 2)
    if df == inf or df > 1e7:
        return z
    lo, hi = 0.0, z
    while t_two_sided(hi, df) > 1 - level:
        lo, hi = hi, hi * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1 - level else (lo, mid)
        if hi - lo < 1e-14 * hi:
            break
    return (lo + hi) / 2
