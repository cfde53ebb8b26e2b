"""Conditionals, predicates and aggregates with explicit null rules.

Survey data code relies on nulls that *propagate*: a comparison with an unknown
value is unknown, and so is a minimum over a group that holds one.  SQL instead
falls through or skips.  Each helper states which rule it follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def if_else_na(cond: Column, yes, no) -> Column:
    """``yes`` / ``no`` by ``cond``; null where ``cond`` is null."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def not_in(col: Column, values: Iterable) -> Column:
    """``col`` is in none of ``values``; a null is in none, so it is kept."""
    return col.isNull() | ~col.isin(*values)


def paste(*cols: Column, sep: str = " ") -> Column:
    """Join as text; a null becomes the text ``NA``, so it never vanishes silently."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def to_double(col: Column) -> Column:
    """Text to number; null where the text is no plain decimal number."""
    text = col.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def to_int(col: Column) -> Column:
    """Text to whole number, cutting decimals (``'12.0'`` is 12, ``'12A'`` is null)."""
    return to_double(col).try_cast("long")


def overlay(corrected: Column, original: Column) -> Column:
    """The corrected text where there is one and it is not empty."""
    return F.coalesce(F.nullif(corrected, F.lit("")), original)


def strict(agg: Callable[[Column], Column], col: Column) -> Column:
    """``agg(col)``, but null as soon as the group holds one null."""
    return F.when(F.count_if(col.isNull()) == 0, agg(col))


def weighted_mean(x: Column, w: Column, skip_null: bool = True) -> Column:
    """Weighted mean as an aggregate.

    ``skip_null=True`` drops a null ``x`` together with its weight.  With
    ``False`` a null ``x`` makes the result null unless its weight is 0.  A null
    weight on a counted row makes the result null either way, and so does a
    total weight of 0.
    """
    x, w = x.cast("double"), w.cast("double")
    products = F.sum(F.when(w != 0, x * w).otherwise(F.lit(0.0)))
    if skip_null:
        has = x.isNotNull()
        mean = F.try_divide(F.sum(F.when(has & (w != 0), x * w).when(has, F.lit(0.0))), F.sum(F.when(has, w)))
        return F.when(F.count_if(has & w.isNull()) == 0, mean)
    poisoned = F.count_if(w.isNull() | (x.isNull() & (w != 0)))
    return F.when(poisoned == 0, F.try_divide(products, F.sum(w)))
