"""Predictions on value grids with confidence bands.

The grid stays a DataFrame, so predicting at every observed value is distributed.
A prediction is one expression per row: the design row times the coefficients,
with standard error sqrt(d' V d).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .design import Factor, Inter, Num, Poly, PolyConst, SliceTable, part_columns, poly_columns
from .dist import critical
from .regress import Fit

#: How covariates outside the grid are held.
AT_BASE, AT_PROPORTIONS = "base", "proportions"


def value_grid(df: DataFrame, x: str, first: int, last: int, step: int = 1, per: Sequence[str] = ()) -> DataFrame:
    """``x`` from ``first`` to ``last``, once for each combination of ``per`` in ``df``."""
    values = F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step)).cast("array<double>")).alias(x)
    base = df.select(*per).distinct() if per else df.sparkSession.range(1)
    return base.select(*per, values)


def observed_grid(df: DataFrame, x: str, per: Sequence[str] = ()) -> DataFrame:
    """Every value of ``x`` that occurs, per slice."""
    return df.select(*per, F.col(x)).filter(F.col(x).isNotNull()).distinct()


def with_levels(grid: DataFrame, moderator: str, levels: Sequence) -> DataFrame:
    """Each grid row once per moderator level."""
    return grid.withColumn(moderator, F.explode(F.array(*[F.lit(v) for v in levels])))


def predict(fit: Fit, grid: DataFrame, hold: str = AT_PROPORTIONS, level: float = 0.95) -> DataFrame:
    """Add ``predicted``, ``conf_low`` and ``conf_high`` to ``grid``.

    Model columns present in the grid vary with it.  Other numeric columns are
    held at their mean.  Factor and boolean columns are held at their base level
    (``hold='base'``) or at observed proportions (``hold='proportions'``).
    """
    spec = fit.spec
    focal = set(grid.columns)
    keys = list(fit.models)
    names = fit.models[keys[0]].names
    k = len(names)
    polys = spec.polys()
    poly_at = {p: i * PolyConst.WIDTH for i, p in enumerate(polys)}
    numeric = [c for c in spec.columns() if not any(isinstance(p, Factor) and p.column == c for p in spec.parts())]

    def held_mean(key: tuple, c: str) -> float:
        if c in fit.design.booleans and hold == AT_BASE:
            return 0.0
        return fit.models[key].var_means[c]

    upper = [(i, j) for i in range(k) for j in range(i, k)]
    clean = {key: (np.nan_to_num(m.beta), np.nan_to_num(m.cov)) for key, m in fit.models.items()}
    arrays = {
        "__beta": {key: list(clean[key][0]) for key in keys},
        "__cov": {key: [clean[key][1][i, j] for i, j in upper] for key in keys},
        "__mean": {key: list(fit.models[key].means) or [0.0] for key in keys},
        "__var": {key: [held_mean(key, c) for c in numeric] or [0.0] for key in keys},
        "__crit": {key: [critical(level, fit.models[key].df)] for key in keys},
    }
    if polys:
        arrays["__poly"] = fit.design.poly
    table = SliceTable(grid, fit.slices, {n: {key: a[key] for key in keys} for n, a in arrays.items()})

    def value(c: str) -> Column:
        if c in focal:
            return F.col(c).cast("string" if c not in numeric else "double")
        return table.get("__var", numeric.index(c))

    def const(p: Poly) -> list[Column]:
        return [table.get("__poly", poly_at[p] + j) for j in range(PolyConst.WIDTH)]

    def cols(part) -> list[Column]:
        if isinstance(part, Factor) and part.column not in focal:
            if hold == AT_BASE:
                return [F.lit(0.0) for _ in part.levels[1:]]
            return [table.get("__mean", design_at[part] + j) for j in range(len(part.levels) - 1)]
        if isinstance(part, Poly) and part.column in focal:
            return poly_columns(value(part.column), const(part), part.degree)
        return part_columns(part, value, const)

    design_at, at = {}, 0
    for t in spec.terms:
        if not isinstance(t, Inter):
            design_at[t] = at
        at += _width(t)
    d: list[Column] = [F.lit(1.0)]
    at = 0
    for t in spec.terms:
        touched = {t.a.column, t.b.column} if isinstance(t, Inter) else {t.column}
        if not touched & focal and hold == AT_PROPORTIONS:
            d += [table.get("__mean", at + j) for j in range(_width(t))]
        elif isinstance(t, Inter):
            d += [a * b for b in cols(t.b) for a in cols(t.a)]
        else:
            d += cols(t)
        at += _width(t)

    out = table.df.withColumns({f"__d{i}": c for i, c in enumerate(d)})
    eta = sum((F.col(f"__d{i}") * table.get("__beta", i) for i in range(1, k)), F.col("__d0") * table.get("__beta", 0))
    products = (
        f"{1 if i == j else 2} * __d{i} * __d{j} * {table.sql('__cov', pos)}" for pos, (i, j) in enumerate(upper)
    )
    var = F.expr(" + ".join(products))
    margin = table.get("__crit", 0) * F.sqrt(F.greatest(var, F.lit(0.0)))
    out = out.withColumn("__eta", eta).withColumn("__margin", margin)
    link = (lambda c: 1 / (1 + F.exp(-c))) if fit.estimator == "logit" else (lambda c: c)
    out = out.withColumns(
        {
            "predicted": link(F.col("__eta")),
            "conf_low": link(F.col("__eta") - F.col("__margin")),
            "conf_high": link(F.col("__eta") + F.col("__margin")),
        }
    )
    return table.drop(out.drop("__eta", "__margin", *[f"__d{i}" for i in range(k)]))


def _width(t) -> int:
    if isinstance(t, Inter):
        return _width(t.a) * _width(t.b)
    if isinstance(t, Num):
        return 1
    return t.degree if isinstance(t, Poly) else len(t.levels) - 1


def labelled(df: DataFrame, **labels: str) -> DataFrame:
    """Add constant columns that say where stacked rows came from."""
    return df.withColumns({n: F.lit(v) for n, v in labels.items()})


def rescale(df: DataFrame, by: float, cols: Sequence[str] = ("predicted", "conf_low", "conf_high")) -> DataFrame:
    return df.withColumns({c: F.col(c) / by for c in cols})
