"""First row per group, group totals on every row, row numbers.

One group may hold a large share of all rows, so nothing here gathers a group in
one task.  First-per-group keeps one row per group in every map task before the
shuffle (Spark's window group limit).  Group totals are aggregated with map-side
partial sums and joined back instead of being computed in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import left_join

_RN = "__rn"


def first_per_group(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each group by ``order``, which must be total to be repeatable."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RN, F.row_number().over(w)).filter(F.col(_RN) == 1).drop(_RN)


def nulls_last(*cols: str | Column) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in cols]


def with_group_values(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], *, null_safe: bool = True
) -> DataFrame:
    """Add aggregates of each row's group as columns."""
    totals = df.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])
    return left_join(df, totals, list(keys), null_safe=null_safe)


def with_share(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "share", *, small_groups: bool = False, **kw
) -> DataFrame:
    """Each row's share of its group's total; null where the total is 0.

    ``small_groups`` is for rows that are aggregates themselves, a bounded number
    per group (the parties of a state): a window then avoids computing them twice.
    """
    if small_groups:
        total = F.sum(value).over(Window.partitionBy(*keys))
        return df.withColumn(name, F.try_divide(F.col(value), total))
    out = with_group_values(df, keys, {"__total": F.sum(value)}, **kw)
    return out.withColumn(name, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def with_inverse_size(df: DataFrame, keys: Sequence[str], name: str = "w", **kw) -> DataFrame:
    """1 / group size."""
    out = with_group_values(df, keys, {"__n": F.count(F.lit(1))}, **kw)
    return out.withColumn(name, 1.0 / F.col("__n")).drop("__n")


def with_strict_min(df: DataFrame, keys: Sequence[str], value: str, **kw) -> DataFrame:
    """Replace ``value`` by its group minimum, null where the group holds a null."""
    low = F.when(F.count_if(F.col(value).isNull()) == 0, F.min(value))
    return with_group_values(df, keys, {"__low": low}, **kw).withColumn(value, F.col("__low")).drop("__low")


def relabel_mixed(df: DataFrame, keys: Sequence[str], label: str, mixed: str, sums: Sequence[str]) -> DataFrame:
    """Collapse to one row per key: its one label, or ``mixed`` if it has several rows.

    One aggregate replaces a count window followed by a second grouping.
    """
    one = F.when(F.count(F.lit(1)) > 1, F.lit(mixed)).otherwise(F.first(label))
    return df.groupBy(*keys).agg(one.alias(label), *[F.sum(c).alias(c) for c in sums])


#: Ranges that rows are cut into before they are numbered.
RANGES = 128


def with_row_number(df: DataFrame, *order: str, name: str = "row_id") -> DataFrame:
    """1, 2, 3, ... in a total order, without a one-task sort and without materialising the rows.

    The first column must be numeric or a date, and nearly unique or at least without a value that a
    large share of the rows has.  Its approximate quantiles cut the rows into ranges; a row's number
    is its place in its range plus the rows of the ranges before.  Equal values share a range, so
    ties are settled by the other columns.  Nulls come first.
    """
    lead = F.col(order[0])
    kind = df.schema[order[0]].dataType.typeName()
    lead = (F.unix_micros(lead) if kind == "timestamp" else F.unix_date(lead) if kind == "date" else lead).cast("double")
    steps = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = df.agg(F.percentile_approx(lead, steps, F.lit(20 * RANGES)).alias("__cuts"))
    placed = df.join(F.broadcast(cuts)).withColumn(
        "__part", F.coalesce(F.aggregate("__cuts", F.lit(0), lambda n, c: n + (c < lead).cast("int")), F.lit(0))
    ).drop("__cuts")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    below = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = left_join(placed.withColumn("__in", inside), offsets, ["__part"], null_safe=False)
    return out.withColumn(name, F.col("__offset") + F.col("__in")).drop("__part", "__in", "__offset")


def with_row_number_of_text(df: DataFrame, *order: str | Column, name: str = "row_id") -> DataFrame:
    """``with_row_number`` for any order, also of text or of a value that many rows share.

    A global sort range-partitions the rows; the sorted rows are checkpointed, so
    their place is fixed.  A row's number is its position in its partition plus
    the rows of the partitions before, of which there are as many as partitions.
    """
    fixed = cut_lineage(df.orderBy(*order))
    # The id holds the partition in its upper bits and the position in the lower 33.
    placed = fixed.withColumn("__id", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__id", 33))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    below = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__offset"))
    position = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    out = left_join(placed, offsets, ["__part"], null_safe=False)
    return out.withColumn(name, F.col("__offset") + position + 1).drop("__id", "__part", "__offset")


def range_index(x: Column, cuts: Sequence) -> Column:
    """How many of the ascending ``cuts`` are below ``x``, by nested halving."""
    if not cuts:
        return F.lit(0)

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(cuts[mid]), node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(cuts))
