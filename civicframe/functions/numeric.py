"""Row arithmetic over one or several columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import to_int


def across(df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to each of ``cols`` in place."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def by_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def row_sum(cols: Iterable[str | Column]) -> Column:
    """Sum over columns; null if one is null."""
    return reduce(add, [F.col(c) if isinstance(c, str) else c for c in cols])


def relative_change(new: Column, old: Column) -> Column:
    return F.try_divide(new, old) - 1


def reverse_scale(col: Column, top: int) -> Column:
    """Turn a 1..``top`` scale around."""
    return F.lit(top + 1) - col


def grouped_number(col: Column) -> Column:
    """``'1,234'`` to 1234; null where it does not parse."""
    return to_int(F.replace(col, F.lit(","), F.lit("")))


def strictly_between(col: Column, lo: float, hi: float) -> Column:
    return (col > lo) & (col < hi)
