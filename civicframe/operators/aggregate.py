"""Counts, conditional sums, shares and stacked grains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import row_sum


def tally(df: DataFrame, keys: Sequence[str | Column], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def total_and_subset(n: Column, flag: Column, total: str, subset: str) -> list[Column]:
    """Sum of ``n``, and of ``n`` where ``flag`` holds, in one pass."""
    return [F.sum(n).alias(total), F.sum(n * flag.cast("int")).alias(subset)]


def sum_each(cols: Sequence[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in cols]


def sums_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Add the sum per key of each of ``sums``, on the last row of the key by ``order`` and null on the others.

    Sums of doubles depend on the order of their rows.  Here that is ``order``, however the rows are split among files and tasks.  A
    key's rows run through one task, sorted and not held.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.lead(F.lit(True)).over(by).isNull()
    return df.withColumns({name: F.when(last, F.sum(value).over(upto)) for name, value in sums.items()})


def share_of(part: str, whole: Sequence[str]) -> Column:
    """One column's share of the row sum over several; null when that is 0."""
    return F.try_divide(F.col(part), row_sum(whole))


def conditional_ratio(value: Column, cond: Column) -> Column:
    """Share of ``sum(value)`` that comes from rows where ``cond`` holds."""
    return F.try_divide(F.sum(value * cond.cast("int")), F.sum(value))


def stack_grains(
    df: DataFrame, grains: dict[str, str], measures: Sequence[Column], key: str = "GEOID", label: str = "chamber"
) -> DataFrame:
    """The same measures by several alternative keys, stacked with a label.

    ``grains`` maps label to key column.  Grouping sets read the input once and
    sum map-side, where separate groupings would read it once per key.  A null
    key forms a group of its own.
    """
    cols = list(grains.values())
    marks = [F.grouping(c).alias(f"__g_{c}") for c in cols]
    out = df.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(*marks, *measures)
    pick_key, pick_label = F.lit(None), F.lit(None)
    for name, c in reversed(grains.items()):
        here = F.col(f"__g_{c}") == 0
        pick_key = F.when(here, F.col(c)).otherwise(pick_key)
        pick_label = F.when(here, F.lit(name)).otherwise(pick_label)
    rest = [c for c in out.columns if c not in cols and not c.startswith("__g_")]
    return out.select(pick_key.alias(key), pick_label.alias(label), *rest)


def ranked_categories(df: DataFrame, category: str, measure: str, last: str) -> DataFrame:
    """Sort categories by falling measure, with one (such as 'Other') always at the end."""
    return df.orderBy((F.col(category) == last).asc(), F.col(measure).desc(), F.col(category))


def level_rank(col: Column, levels: Sequence[str]) -> Column:
    """Position of a value in an explicit level order; null for unknown values."""
    out = F.lit(None).cast("int")
    for i, level in reversed(list(enumerate(levels, start=1))):
        out = F.when(col == level, F.lit(i)).otherwise(out)
    return out
