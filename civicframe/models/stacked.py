"""Many small systems and tail areas at once: numpy arrays with one row per model."""

from __future__ import annotations

from functools import lru_cache
from math import erfc, inf, lgamma

import numpy as np

from .dist import critical

_critical = lru_cache(1 << 16)(critical)


def symmetric(products: np.ndarray, k: int) -> np.ndarray:
    """Square matrices from the upper triangles' entries, row by row."""
    out = np.zeros((len(products), k, k))
    i, j = np.triu_indices(k)
    out[:, i, j] = products
    out[:, j, i] = products
    return out


def inverses(gram: np.ndarray, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of cross-product matrices by sweeping, and which columns are in them.

    A column is left out where earlier ones explain it up to ``tolerance`` of its square; its row and column are zero.
    """
    n, k, _ = gram.shape
    diagonal = np.einsum("nii->ni", gram)
    scale = np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    a = gram / scale[:, :, None] / scale[:, None, :]
    kept = np.zeros((n, k), bool)
    for j in range(k):
        pivot = a[:, j, j]
        use = (diagonal[:, j] > 0) & (pivot > tolerance)
        kept[:, j] = use
        side = a[:, :, j] / np.where(use, pivot, 1.0)[:, None]
        swept = a - side[:, :, None] * a[:, None, j, :]
        swept[:, j, :] = swept[:, :, j] = side
        swept[:, j, j] = -1.0 / np.where(use, pivot, 1.0)
        a = np.where(use[:, None, None], swept, a)
    both = kept[:, :, None] & kept[:, None, :]
    return np.where(both, -a, 0.0) / scale[:, :, None] / scale[:, None, :], kept


def from_centre(mean: np.ndarray, centre: np.ndarray, slopes: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and their variances with the intercept at zero, from the value at the means and the slopes (cov of both)."""
    lift = np.concatenate([np.ones((len(mean), 1)), -mean], axis=1)
    first = np.einsum("ni,nij,nj->n", lift, cov, lift)
    variances = np.concatenate([first[:, None], np.einsum("nii->ni", cov)[:, 1:]], axis=1)
    return np.concatenate([(centre - np.einsum("ni,ni->n", mean, slopes))[:, None], slopes], axis=1), variances


def _fractions(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fractions of the incomplete beta function, all at once."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / np.where(np.abs(d) > tiny, d, tiny)
    h = d.copy()
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) > tiny, d, tiny)
            c = 1.0 + num / c
            c = np.where(np.abs(c) > tiny, c, tiny)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|) for Student's t; the normal for infinite df, NaN where t is NaN."""
    out = np.full(len(t), np.nan)
    normal = np.isfinite(t) & (df > 1e7)
    out[normal] = [erfc(abs(z) / 2**0.5) for z in t[normal]]
    use = np.isfinite(t) & (df <= 1e7) & (df > 0)
    if use.any():
        a, t2, df = df[use] / 2, t[use] ** 2, df[use]
        x = df / (df + t2)
        known, at = np.unique(a, return_inverse=True)
        front = np.array([lgamma(v + 0.5) - lgamma(v) - lgamma(0.5) for v in known])[at] - a * np.log1p(t2 / df)
        with np.errstate(divide="ignore"):
            front = np.exp(front + 0.5 * np.log(t2 / (df + t2)))
        half = np.full(len(a), 0.5)
        lower = x < (a + 1) / (a + 2.5)
        found = np.empty(len(a))
        found[lower] = front[lower] * _fractions(a[lower], half[lower], x[lower]) / a[lower]
        found[~lower] = 1.0 - front[~lower] * _fractions(half[~lower], a[~lower], 1 - x[~lower]) / half[~lower]
        out[use] = found
    out[np.isinf(t)] = 0.0
    return out


def criticals(level: float, df: np.ndarray) -> np.ndarray:
    known, at = np.unique(np.where(df > 1e7, inf, df), return_inverse=True)
    return np.array([_critical(level, float(v)) for v in known])[at]
