"""Left joins, overrides, overlays and match reports.

No hint is given for the small side of a join: Spark broadcasts it only when its
size, from file statistics or measured by AQE, is below the session's limit, and
sort-merges with skew splitting otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = str | tuple[str, str]

_RIGHT = "__right_"
_SALT = "__salt"


def _pairs(on: Sequence[Key]) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else k for k in on]


def _match(pairs: Sequence[tuple[str, str]], null_safe: bool) -> Column:
    def one(lk: str, rk: str) -> Column:
        left, right = F.col(lk), F.col(_RIGHT + rk)
        return left.eqNullSafe(right) if null_safe else left == right

    return reduce(lambda a, b: a & b, [one(lk, rk) for lk, rk in pairs])


def _hide_keys(right: DataFrame, pairs: Sequence[tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    return right.select(*[F.col(rk).alias(_RIGHT + rk) for _, rk in pairs], *[F.col(c) for c in keep])


def left_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[Key],
    *,
    null_safe: bool = True,
    expect: str = "many",
    salt: int = 1,
) -> DataFrame:
    """Left equi-join; right key columns are dropped.

    ``on`` holds shared names or ``(left, right)`` pairs.  A null key matches a
    null key unless ``null_safe=False``; pass that for keys known to hold no
    null, since a plain equality can reuse an existing partitioning by the key.
    ``expect='one'`` fails if a right key repeats.  ``salt=n`` spreads each key
    of the left side over ``n`` tasks and repeats the right side ``n`` times:
    for a left key so frequent that one task cannot hold its rows.
    """
    pairs = _pairs(on)
    keep = [c for c in right.columns if c not in {rk for _, rk in pairs}]
    clash = sorted(set(keep) & set(left.columns))
    if clash:
        raise ValueError(f"columns on both sides, rename or drop first: {clash}")
    if expect == "one":
        assert_unique(right, [rk for _, rk in pairs])
    slim = _hide_keys(right, pairs, keep)
    cond = _match(pairs, null_safe)
    if salt > 1:
        left_cols = [F.col(c) for c in left.columns]
        spread = left.withColumn(_SALT, F.pmod(F.xxhash64(*left_cols), F.lit(salt)).cast("int"))
        slim = slim.withColumn(_RIGHT + _SALT, F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        cond = cond & (F.col(_SALT) == F.col(_RIGHT + _SALT))
        joined = spread.join(slim, cond, "left").drop(_SALT, _RIGHT + _SALT)
    else:
        joined = left.join(slim, cond, "left")
    return joined.drop(*[_RIGHT + rk for _, rk in pairs])


def join_all(first: DataFrame, others: Sequence[DataFrame], on: Sequence[Key], **kw) -> DataFrame:
    """Left join several tables at one grain."""
    return reduce(lambda acc, nxt: left_join(acc, nxt, on, **kw), others, first)


def _exists(left: DataFrame, right: DataFrame, on: Sequence[Key], how: str, null_safe: bool) -> DataFrame:
    pairs = _pairs(on)
    return left.join(_hide_keys(right, pairs, []), _match(pairs, null_safe), how)


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[Key], *, null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` whose key is absent from ``right``; nulls compare equal."""
    return _exists(left, right, on, "left_anti", null_safe)


#: The rows a left join failed to match, for a report before they are dropped.
unmatched = anti_join


def override(base: DataFrame, replacement: DataFrame, on: Sequence[Key], **kw) -> DataFrame:
    """``replacement`` plus the base rows whose key it does not hold.

    Columns only one side has are null on the other.
    """
    return anti_join(base, replacement, on, **kw).unionByName(replacement, allowMissingColumns=True)


def correct(
    df: DataFrame, corrections: DataFrame, on: Sequence[Key], cols: dict[str, str], **kw
) -> DataFrame:
    """Replace columns by their non-empty corrections: ``{column: correction column}``."""
    out = left_join(df, corrections, on, **kw)
    fixed = {c: F.coalesce(F.nullif(F.col(fix), F.lit("")), F.col(c)) for c, fix in cols.items()}
    return out.withColumns(fixed).drop(*cols.values())


def fill_from_dimension(dimension: DataFrame, facts: DataFrame, on: Sequence[Key], zero: Sequence[str], **kw) -> DataFrame:
    """One row per dimension member, facts joined on, absent counts filled with 0."""
    return left_join(dimension, facts, on, **kw).na.fill(0, subset=list(zero))


def stack(*frames: DataFrame) -> DataFrame:
    """Union all by name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prefer_first(primary: DataFrame, fallback: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Rows of both; where both hold a key, the primary wins.  A null primary value counts as absent."""
    return override(fallback, primary.filter(F.col(value).isNotNull()), on)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    found = repeated_keys(df, keys).limit(3).collect()
    if found:
        raise ValueError(f"keys {list(keys)} repeat, for example {found}")
