"""Coefficient and fit tables as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from math import exp, isnan

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.local import small_frame
from .dist import critical, normal_two_sided, t_two_sided
from .regress import Fit

STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def _key_fields(fit: Fit) -> list[T.StructField]:
    return [T.StructField(s, fit.design.rows.schema[s].dataType) for s in fit.slices]


def _frame(fit: Fit, fields: Sequence[tuple[str, T.DataType]], rows: list[tuple]) -> DataFrame:
    schema = T.StructType(_key_fields(fit) + [T.StructField(n, t) for n, t in fields])
    return small_frame(fit.design.rows.sparkSession, rows, schema)


def coefficients(fit: Fit, level: float = 0.95, exponentiate: bool = False) -> DataFrame:
    """One row per slice and term, with interval, p-value and stars.

    Linear fits use Student's t with n - k degrees of freedom, logistic and Huber
    fits the normal.  Terms dropped as collinear have nulls.  ``exponentiate``
    turns the estimate and its bounds into odds ratios.
    """
    rows = []
    for key, m in fit.models.items():
        crit = critical(level, m.df)
        for i, name in enumerate(m.names):
            est, var = float(m.beta[i]), float(m.cov[i, i])
            if isnan(est):
                rows.append((*key, name, *[None] * 6, ""))
                continue
            se = max(var, 0.0) ** 0.5
            stat = est / se if se > 0 else None
            p = None if stat is None else normal_two_sided(stat) if fit.normal else t_two_sided(stat, m.df)
            stars = "" if p is None else next((s for cut, s in STARS if p < cut), "")
            show = exp if exponentiate else (lambda v: v)
            bounds = (None, None) if isnan(se) else (show(est - crit * se), show(est + crit * se))
            rows.append((*key, name, show(est), None if isnan(se) else se, stat, p, *bounds, stars))
    numbers = ("estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high")
    fields = [("term", T.StringType()), *[(n, T.DoubleType()) for n in numbers], ("stars", T.StringType())]
    return _frame(fit, fields, rows)


def unfitted(fit: Fit) -> DataFrame:
    """One row per slice without a model, with the reason."""
    return _frame(fit, [("reason", T.StringType())], [(*key, reason) for key, reason in fit.unfitted.items()])


def fit_stats(fit: Fit, omit: str | None = None) -> DataFrame:
    """One row per slice; columns whose name matches the pattern ``omit`` are left out."""
    names = [n for n in next(iter(fit.models.values())).stats if not (omit and re.search(omit, n, re.IGNORECASE))]
    rows = [
        (*key, *[int(m.stats[n]) if n in ("nobs", "groups") else float(m.stats[n]) for n in names])
        for key, m in fit.models.items()
    ]
    kinds = [(n, T.LongType() if n in ("nobs", "groups") else T.DoubleType()) for n in names]
    return _frame(fit, kinds, rows)


def label_terms(coefs: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Keep the terms of ``labels``, in its order, under their new names (columns label, rank)."""
    spark = coefs.sparkSession
    ranks = {label: i for i, label in reversed(list(enumerate(labels.values(), start=1)))}
    side = small_frame(
        spark, [(t, label, ranks[label]) for t, label in labels.items()], "__term string, label string, rank int"
    )
    return coefs.join(F.broadcast(side), F.col("term") == F.col("__term")).drop("__term")


def side_by_side(coefs: DataFrame, model: str, models: Sequence[str], decimals: int = 1) -> DataFrame:
    """One row per label, one text column per model: ``estimate*** [low, high]``."""
    f = f"%.{decimals}f"
    text = F.concat(F.format_string(f, "estimate"), F.col("stars"),
                    F.format_string(f" [{f}, {f}]", F.col("conf_low"), F.col("conf_high")))
    cells = [F.max(F.when(F.col(model) == m, F.col("__cell"))).alias(m) for m in models]
    return coefs.withColumn("__cell", text).groupBy("label", "rank").agg(*cells).orderBy("rank")
