"""Long to wide, wide to long, cross-tabs.

Levels are named by the caller, so widening is one grouping with conditional
aggregates: one shuffle with map-side combining, no pass to discover levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(value: str, here: Column, fill) -> Column:
    present = F.count_if(here)
    one = F.max(F.when(here, F.col(value)))
    checked = F.when(present > 1, F.raise_error(F.lit(f"two rows for one cell of {value}"))).otherwise(one)
    return checked if fill is None else F.when(present == 0, F.lit(fill)).otherwise(checked)


def widen(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    levels: Sequence,
    values: Sequence[str],
    *,
    fill=None,
    name=None,
) -> DataFrame:
    """One row per id, one column per (value, level).

    ``fill`` replaces cells that have no input row; a null that was in the input
    stays.  Two rows for one cell are an error.  Columns are named ``value_level``
    (just ``level`` for a single value), or by ``name(value, level)``.
    """
    single = len(values) == 1
    name = name or (lambda v, lv: str(lv) if single else f"{v}_{lv}")
    cells = [
        _cell(v, F.col(names_from) == F.lit(lv), fill).alias(name(v, lv)) for v in values for lv in levels
    ]
    return df.groupBy(*ids).agg(*cells)


def lengthen(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], names_to: str = "name", values_to: str = "value"
) -> DataFrame:
    return df.unpivot(list(ids), list(cols), names_to, values_to)


def crosstab_cells(
    df: DataFrame,
    ids: Sequence[str],
    blocks: dict[str, Column],
    columns: dict[str, Column],
    part: Column,
    *,
    empty_block: str,
) -> DataFrame:
    """Text cells ``'part / all'`` by id, for each (column, block).

    A block (a chamber) with no row at all for the id gives ``empty_block``; a
    column (a party) with no row in a present block gives null.  All counts come
    from one grouping.
    """
    aggs, cells = [], []
    for b, in_block in blocks.items():
        aggs.append(F.count_if(in_block).alias(f"__{b}"))
        for c, in_col in columns.items():
            aggs.append(F.count_if(in_block & in_col).alias(f"__{c}_{b}"))
            aggs.append(F.count_if(in_block & in_col & part).alias(f"__{c}_{b}_part"))
    for b in blocks:
        for c in columns:
            whole, some = F.col(f"__{c}_{b}"), F.col(f"__{c}_{b}_part")
            text = F.when(whole > 0, F.concat_ws(" / ", some.cast("string"), whole.cast("string")))
            cells.append(F.when(F.col(f"__{b}") == 0, F.lit(empty_block)).otherwise(text).alias(f"{c}_{b}"))
    return df.groupBy(*ids).agg(*aggs).select(*ids, *cells)
