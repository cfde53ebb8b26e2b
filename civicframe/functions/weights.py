"""Weighted means split into sums, so rows can be aggregated before a join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = ("wx", "w", "bad")


def weighted_sums(x: Column, w: Column, skip_null: bool = True, prefix: str = "__") -> list[Column]:
    """First stage: weighted total, weight and count of rows that make the mean null."""
    x, w = x.cast("double"), w.cast("double")
    if skip_null:
        has = x.isNotNull()
        weight, bad = F.when(has, w), has & w.isNull()
    else:
        weight, bad = w, w.isNull() | (x.isNull() & (w != 0))
    product = F.when(w != 0, x * w).otherwise(F.lit(0.0))
    columns = (F.coalesce(F.sum(product), F.lit(0.0)), F.sum(weight), F.count_if(bad))
    return [c.alias(prefix + n) for c, n in zip(columns, _PARTS)]


def weighted_mean_of_sums(prefix: str = "__") -> Column:
    """Second stage, over rows that carry the sums of the first."""
    wx, w, bad = (F.sum(prefix + n) for n in _PARTS)
    return F.when(bad == 0, F.try_divide(wx, w))
