"""Ordered recode rules as data.

Rules run in order and each sees what the earlier ones made.  Neighbouring exact
rules are composed into one lookup.  All steps of a recode form one expression in
which every step names its input once, as the variable of a one-element
``transform``.  Chained conditional columns would name it several times, and a
filter above them, once pushed down, would grow as a power of the rule count.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Exact:
    """``column == old`` becomes ``new``."""

    old: str
    new: str

    def condition(self, column: str) -> str:
        return f"{column} = {quoted(self.old)}"

    def value(self, column: str) -> str:
        return quoted(self.new)


@dataclass(frozen=True)
class Swap:
    """Replace a regular expression in keys that satisfy ``when`` (a SQL predicate)."""

    when: str
    pattern: str
    new: str = ""

    def condition(self, column: str) -> str:
        return self.when

    def value(self, column: str) -> str:
        return f"regexp_replace({column}, {quoted(self.pattern)}, {quoted(self.new)})"


@dataclass(frozen=True)
class Assign:
    """Set the column to ``new`` where ``when`` (a SQL predicate over any column) holds.

    ``strict=True`` sets null where the predicate is null, as a conditional in a
    null-propagating language would.
    """

    when: str
    new: str
    strict: bool = False

    def condition(self, column: str) -> str:
        return self.when

    def value(self, column: str) -> str:
        return quoted(self.new)


@dataclass(frozen=True)
class Compute:
    """Set the column to the SQL expression ``new`` where ``when`` holds."""

    when: str
    new: str

    def condition(self, column: str) -> str:
        return self.when

    def value(self, column: str) -> str:
        return self.new


Rule = Exact | Swap | Assign | Compute


def compose_exact(rules: Sequence[Exact]) -> dict[str, str]:
    """One lookup with the effect of running exact rules in order."""
    table = {}
    for start in dict.fromkeys(r.old for r in rules):
        key = start
        for r in rules:
            if key == r.old:
                key = r.new
        if key != start:
            table[start] = key
    return table


def _step(column: str, rule: Rule) -> str:
    """SQL for what one rule makes of ``column``."""
    cond = rule.condition(column)
    unknown = f"WHEN ({cond}) IS NULL THEN NULL " if isinstance(rule, Assign) and rule.strict else ""
    return f"CASE {unknown}WHEN {cond} THEN {rule.value(column)} ELSE {column} END"


def _lookup(column: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {quoted(old)} THEN {quoted(new)}" for old, new in table.items())
    return f"CASE {column} {cases} ELSE {column} END"


def _steps(column: str, rules: Sequence[Rule]) -> list[str]:
    steps = []
    for exact, run in groupby(rules, key=lambda r: isinstance(r, Exact)):
        run = list(run)
        if exact:
            table = compose_exact(run)
            steps += [_lookup(column, table)] if table else []
        else:
            steps += [_step(column, r) for r in run]
    return steps


def recode(df: DataFrame, column: str, rules: Sequence[Rule]) -> DataFrame:
    """Run ``rules`` in order on ``column``, a text column with a plain name."""
    expr = column
    for step in _steps(column, rules):
        # The variable shadows the column, so the step reads the previous result.
        expr = f"transform(array({expr}), {column} -> {step})[0]"
    return df.withColumn(column, F.expr(expr))


def rule_hits(df: DataFrame, column: str, rules: Sequence[Rule]) -> DataFrame:
    """How many rows each rule matches when its turn comes: (rule, hits), zeros included.

    One pass, one row of sums; a rule with 0 hits is dead and shows up here.
    """
    names = df.columns
    flags = []
    for i, rule in enumerate(rules):
        flag = f"__hit_{i}"
        hit = F.expr(f"CASE WHEN {rule.condition(column)} THEN 1L ELSE 0L END")
        df = df.select(*names, *flags, hit.alias(flag))
        df = df.withColumn(column, F.expr(_step(column, rule)))
        flags.append(flag)
    sums = df.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in flags])
    long = sums.unpivot([], flags, "__flag", "hits")
    return long.select(F.substring("__flag", 7, 9).cast("int").alias("rule"), "hits")


def dependent_rules(rules: Sequence[Rule]) -> list[tuple[int, int]]:
    """Pairs (i, j) of exact rules where rule j reads what rule i wrote."""
    exact = [(i, r) for i, r in enumerate(rules) if isinstance(r, Exact)]
    return [(i, j) for i, a in exact for j, b in exact if i < j and a.new == b.old]


def in_list(column: str, values: Sequence[str]) -> str:
    """SQL text ``column in (...)`` for a rule predicate."""
    for v in values:
        if re.search(r"['\\]", v):
            raise ValueError(f"unsafe literal {v!r}")
    return f"{column} in ({', '.join(repr(v) for v in values)})"
