"""Text and date expressions for dirty identifiers, paths and labels."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import to_int


def chars(col: Column, first: int, last: int | None = None) -> Column:
    """Characters ``first..last`` (1-based, both included), or to the end."""
    length = F.lit(last - first + 1) if last is not None else F.length(col)
    return F.substring(col, F.lit(first), length)


def last_char(col: Column) -> Column:
    return F.right(col, F.lit(1))


def ends_with_capital(col: Column) -> Column:
    return col.rlike("[A-Z]$")


def last_segment(col: Column, sep: str = "/") -> Column:
    """What follows the last ``sep``; the whole text if there is none."""
    return F.substring_index(col, sep, -1)


def squeeze(col: Column) -> Column:
    """Drop every blank."""
    return F.replace(col, F.lit(" "), F.lit(""))


def trim_blank(col: Column) -> Column:
    return F.btrim(col, F.lit(" \t\r\n"))


def pad_left(col: Column, width: int, pad: str = "0") -> Column:
    """Left pad; unlike ``lpad``, never cuts longer text."""
    return F.when(F.length(col) >= width, col).otherwise(F.lpad(col, width, pad))


def title_case(col: Column) -> Column:
    return F.initcap(col)


def ratio_cell(part: Column, whole: Column) -> Column:
    """``'part / whole'``; null when the whole is 0."""
    return F.when(whole != 0, F.concat_ws(" / ", part.cast("string"), whole.cast("string")))


def thousands(col: Column) -> Column:
    return F.format_number(col, 0)


def percent(col: Column, decimals: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{decimals}f", F.round(col.cast("double") * 100, decimals)), F.lit("%"))


def snake_names(df: DataFrame) -> DataFrame:
    """Rename columns to lower snake case, numbering repeats."""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = re.sub(r"[^0-9a-zA-Z]+", "_", raw).strip("_").lower() or "x"
        if name[0].isdigit():
            name = f"x{name}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def split_columns(df: DataFrame, col: str, sep: str, width: int, prefix: str | None = None) -> DataFrame:
    """Split ``col`` on ``sep`` into ``prefix_1 .. prefix_width``; absent parts are null."""
    parts = F.split(F.col(col), re.escape(sep))
    stem = prefix or col
    return df.withColumns(
        {f"{stem}_{i + 1}": F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")) for i in range(width)}
    )


@dataclass(frozen=True)
class NumberRule:
    """How one set of scopes writes the number inside an identifier.

    ``H0061`` with ``keep=1, insert='B'`` becomes ``HB61``.  Identifiers that
    start with one of ``unless`` stay as they are when their scope is listed in
    ``unless_scopes``.
    """

    scopes: tuple[str, ...]
    keep: int
    insert: str = ""
    unless: tuple[str, ...] = ()
    unless_scopes: tuple[str, ...] = ()


def strip_leading_zeros(identifier: Column, scope: Column, rules: Sequence[NumberRule]) -> Column:
    """Drop leading zeros of the number inside ``identifier`` by the rule of its scope.

    The scopes of the rules must not overlap.  An identifier whose number does not
    parse stays as it is, so that no two of them fall together.
    """
    listed = [s for r in rules for s in r.scopes]
    if len(listed) != len(set(listed)):
        raise ValueError("a scope is listed in two rules")
    out = None
    for r in rules:
        applies = scope.isin(*r.scopes)
        for head in r.unless:
            applies = applies & ~(scope.isin(*r.unless_scopes) & identifier.startswith(head))
        number = to_int(chars(identifier, r.keep + 1)).cast("string")
        value = F.coalesce(F.concat(chars(identifier, 1, r.keep), F.lit(r.insert), number), identifier)
        out = F.when(applies, value) if out is None else out.when(applies, value)
    return identifier if out is None else out.otherwise(identifier)


def parse_date(col: Column, fmt: str | None = None) -> Column:
    """Text to date, null where it does not parse."""
    return F.try_to_date(col, fmt) if fmt else F.try_to_date(col)


def year_or_text(date: Column, text: Column) -> Column:
    """Year of ``date``; where that is null, the first four characters of ``text``."""
    return F.coalesce(F.year(date).cast("long"), to_int(chars(text, 1, 4)))
