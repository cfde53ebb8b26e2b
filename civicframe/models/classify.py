"""Natural breaks, right-closed bins and integer range labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.groups import range_index

#: Ranges that the values are summed up in at first, and ends added in a round.
RANGES = 1024


def jenks_breaks(df: DataFrame, column: str, classes: int, round_to: float | None = None) -> list[float]:
    """Class limits that minimise the summed squared deviation within classes, for any number of distinct values.

    Returns minimum, upper limits of the inner classes, maximum.  The values are summed up in ranges (approximate quantiles), and
    the optimum over whole ranges bounds the cost from above.  A limit inside a range costs at least what the
    classes cost without that range.  Ranges that such a limit could still make cheaper are cut finer by one pass over their
    values, ends that no solution as cheap goes through are taken out, and so on until no limit inside a range of several values can be as
    cheap: the optimum over ranges is then that over values.  ``round_to`` rounds values first.  Solutions equal up to
    rounding (1e-12 of all squared deviation) resolve to the smallest limits.
    """
    x = F.col(column).cast("double")
    if round_to:
        x = F.round(x / round_to) * round_to
    data = df.filter(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    ends = _quantiles(data, RANGES)
    if not ends:
        raise ValueError("no values")
    closed: set[float] = set()
    while True:
        bins = _summary(data, ends)
        found = _limits(bins, classes)
        if len(bins) <= classes and all(b["low"] == b["high"] for b in bins):
            return [float(bins[0]["low"]), *[float(b["high"]) for b in bins]]
        wide = np.array([b["low"] < b["high"] and e not in closed for b, e in zip(bins, _ends_of(bins, ends))])
        at_end, inside = _through(bins, classes, wide, found)
        if not inside.any():
            return [float(bins[0]["low"]), *[float(bins[at]["high"]) for at in found], float(bins[-1]["high"])]
        ends, closed = _refined(data, bins, _ends_of(bins, ends), at_end, inside)


def _ends_of(bins: Sequence, ends: Sequence[float]) -> list[float]:
    """The upper end of the range that each summary belongs to."""
    return [float(ends[i]) for i in np.searchsorted(np.asarray(ends), [b["high"] for b in bins])]


def _quantiles(data: DataFrame, n: int) -> list[float]:
    """Upper ends of about ``n`` ranges with equal counts; the maximum is one of them."""
    steps = [i / n for i in range(1, n)]
    row = data.agg(F.percentile_approx("x", steps, F.lit(20 * n)).alias("q"), F.max("x").alias("top")).first()
    return sorted({*row["q"], row["top"]}) if row["top"] is not None else []


def _through(bins: Sequence, classes: int, wide: np.ndarray, found: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which ends of ranges, and which wide ranges, a limit may lie at or in without costing more than the limits found.

    The least cost with a limit inside a range leaves that range out, since a class only loses deviation with
    each value taken from it.  Least costs from the left and from the right add up to that of all solutions through a place.
    """
    m = len(bins)
    n, s, q = (np.concatenate([[0.0], np.cumsum([b[c] for b in bins])]) for c in ("n", "s", "q"))

    def cost(i, j):
        """Squared deviation of whole ranges i..j-1 as one class; nothing for no range."""
        return np.maximum(q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(n[j] - n[i], 1.0), 0.0)

    cuts = [0, *[at + 1 for at in found], m]
    most = sum(float(cost(i, j)) for i, j in zip(cuts, cuts[1:])) + 1e-12 * float(cost(0, m))
    places = np.arange(m + 1)
    left, right = [np.where(places == 0, 0.0, np.inf)], [np.where(places == m, 0.0, np.inf)]
    left_in, right_in = [np.full(m, np.inf)], [np.full(m, np.inf)]
    for _ in range(classes - 1):
        start = np.minimum(left[-1], np.concatenate([[np.inf], left_in[-1]]))
        ahead = np.array([np.min(start[: j + 1] + cost(places[: j + 1], j)) for j in places])
        left.append(ahead)
        left_in.append(np.where(wide, np.minimum(ahead[:m], left_in[-1]), np.inf))
        end = np.minimum(right[-1], np.concatenate([right_in[-1], [np.inf]]))
        behind = np.array([np.min(cost(i, places[i:]) + end[i:]) for i in places])
        right.append(behind)
        right_in.append(np.where(wide, np.minimum(behind[1:], right_in[-1]), np.inf))
    pairs = [(c, classes - c) for c in range(1, classes)]
    at_end = np.min([left[a] + right[b] for a, b in pairs], axis=0)[1:] if pairs else np.full(m, np.inf)
    inside = np.min([left_in[a] + right_in[b] for a, b in pairs], axis=0) if pairs else np.full(m, np.inf)
    return at_end <= most, inside <= most


def _refined(data: DataFrame, bins: Sequence, ends: list[float], at_end: np.ndarray, inside: np.ndarray) -> tuple[list[float], set[float]]:
    """New ends: ranges that may hold a limit are cut, others merged; and the ends of ranges known to hold none."""
    open_ = [i for i in range(len(bins)) if inside[i]]
    each = max(2, RANGES // len(open_))
    lows, highs = [float(bins[i]["low"]) for i in open_], [float(bins[i]["high"]) for i in open_]
    # The range of a value among those to be cut, by the same placing as the summaries.
    placed = _placed(data.filter((F.col("x") >= lows[0]) & (F.col("x") <= highs[-1])), ends)
    steps = [k / each for k in range(1, each)]
    cut = placed.filter(F.col("at").isin([float(len(ends) - 1 - i) for i in open_])).groupBy("at")
    cut = cut.agg(F.percentile_approx("x", steps, F.lit(20 * each)).alias("q")).collect()
    new, closed = {v for r in cut for v in r["q"]} | set(lows) | {ends[i] for i in open_}, set()
    for i, end in enumerate(ends):
        if not inside[i] and (at_end[i] or i + 1 == len(ends) or inside[i + 1]):
            new.add(end)
            closed.add(end)
    return sorted(new), closed


def _placed(data: DataFrame, ends: Sequence[float]) -> DataFrame:
    """``at``: the range (previous end, end] of each value, numbered from the last one."""
    if len(ends) == 1:
        return data.withColumn("at", F.lit(0.0))
    # The bucketizer's ranges are closed below, so the turned values go in.
    splits = [*[-float(e) for e in reversed(ends)], float("inf")]
    return Bucketizer(splits=splits, inputCol="turned", outputCol="at").transform(data.withColumn("turned", -F.col("x")))


def _summary(data: DataFrame, ends: Sequence[float]) -> list:
    """Count, sum, sum of squares and extremes of the values in ranges (previous end, end], in order."""
    middle = (ends[0] + ends[-1]) / 2
    d = F.col("x") - F.lit(middle)
    placed = _placed(data, ends)
    rows = placed.groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    return sorted(rows.collect(), key=lambda r: r["low"])


def _limits(bins: Sequence, classes: int) -> list[int]:
    """The last range of every class but the last."""
    if len(bins) <= classes:
        return []
    n, s, q = (np.concatenate([[0.0], np.cumsum([b[c] for b in bins])]) for c in ("n", "s", "q"))
    return _fisher(n, s, q, classes)


def fisher_breaks(values: Sequence[float], weights: Sequence[int], classes: int) -> list[float]:
    """Fisher's optimal grouping of sorted distinct values: minimum, upper limits, maximum."""
    x, w = np.asarray(values, float), np.asarray(weights, float)
    m = len(x)
    if m == 0:
        raise ValueError("no values")
    if m <= classes:
        return [float(x[0]), *map(float, x)]
    c = x - np.average(x, weights=w)
    n, s, q = (np.concatenate([[0], np.cumsum(v)]) for v in (w, w * c, w * c * c))
    return [float(x[0]), *[float(x[i]) for i in _fisher(n, s, q, classes)], float(x[-1])]


def _fisher(n: np.ndarray, s: np.ndarray, q: np.ndarray, classes: int) -> list[int]:
    """The last place of every class but the last, from running counts, sums and sums of squares; by halving each layer.

    The best start of the last class moves right with its end, so each layer
    needs about m log m cost lookups in place of m squared.
    """
    m = len(n) - 1

    def cost(i, j):
        """Squared deviation of values i..j-1 as one class."""
        return np.maximum(q[j] - q[i] - (s[j] - s[i]) ** 2 / (n[j] - n[i]), 0.0)

    best = cost(0, np.arange(1, m + 1))
    best = np.concatenate([[np.inf], best])
    starts = []
    for layer in range(2, classes + 1):
        new = np.full(m + 1, np.inf)
        start = np.zeros(m + 1, int)
        todo = [(layer, m, layer - 1, m - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(max(first, layer - 1), min(last, mid - 1) + 1)
            total = best[i] + cost(i, mid)
            at = int(np.argmin(total))
            # Values that differ by rounding only count as equal: take the smallest.
            near = np.nonzero(total <= total[at] + 1e-12 * max(q[m], 1e-300))[0][0]
            new[mid], start[mid] = total[near], i[near]
            todo.append((lo, mid - 1, first, int(i[at])))
            todo.append((mid + 1, hi, int(i[near]), last))
        best = new
        starts.append(start)
    ends, end = [], m
    for start in reversed(starts):
        end = int(start[end])
        ends.append(end - 1)
    return ends[::-1]


def cut(x: Column, breaks: Sequence[float]) -> Column:
    """Class number 1.. of ``x`` in ``(a, b]`` classes, the lowest closed on both sides; null outside."""
    inner = list(breaks)[1:-1]
    inside = (x >= F.lit(breaks[0])) & (x <= F.lit(breaks[-1]))
    return F.when(inside, range_index(x, inner) + 1)


def _pick(index: Column, values: Sequence) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index - 1)


def interval_label(index: Column, breaks: Sequence[float]) -> Column:
    """``[0,5]`` for the lowest class, ``(5,13]`` for the others."""
    texts = [f"{'[' if i == 0 else '('}{a:g},{b:g}]" for i, (a, b) in enumerate(zip(breaks, breaks[1:]))]
    return _pick(index, texts)


def range_label(index: Column, breaks: Sequence[float]) -> Column:
    """Whole numbers of the class as ``lo-hi``: an open lower limit moves up by one."""
    texts = [f"{int(a) + (i > 0)}-{int(b)}" for i, (a, b) in enumerate(zip(breaks, breaks[1:]))]
    return _pick(index, texts)


def with_classes(df: DataFrame, column: str, breaks: Sequence[float], name: str = "class") -> DataFrame:
    """Add class number, interval text and range label."""
    index = cut(F.col(column), breaks)
    return df.withColumns(
        {name: index, f"{name}_interval": interval_label(index, breaks), f"{name}_range": range_label(index, breaks)}
    )
