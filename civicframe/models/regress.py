"""OLS, OLS with robust covariance, group fixed effects, logistic, Huber.

All estimators share one step: sums of z_i z_j and z_i y per slice, where z are
design columns moved near their means so that no digits are lost.  Every slice of
a spec is fitted in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import inf, log, log1p, pi, sqrt

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .design import Design, SliceTable, Spec, build

HUBER_K = 1.345
MAD_TO_SD = 0.6745
#: A direction separates an outcome if no row lies on the wrong side by more than this share of the furthest.
SEPARATES = 1e-6


@dataclass
class SliceFit:
    """One fitted model.  Index 0 is the intercept; dropped terms hold NaN."""

    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    df: float
    means: np.ndarray
    var_means: dict[str, float]
    stats: dict[str, float]
    dropped: list[str]


@dataclass
class Fit:
    spec: Spec
    slices: list[str]
    estimator: str
    models: dict[tuple, SliceFit]
    design: Design
    #: Slices without a model, with the reason.
    unfitted: dict[tuple, str] = field(default_factory=dict)

    @property
    def normal(self) -> bool:
        """Normal instead of t quantiles: the likelihood and M-estimators."""
        return self.estimator in ("logit", "huber")


class SeparationError(ValueError):
    """The outcome is predicted perfectly, so no finite estimate exists."""


def _solve(gram: np.ndarray, names: Sequence[str]) -> tuple[np.ndarray, list[int]]:
    """Inverse of a cross-product matrix; a column explained by earlier ones is left out."""
    k = len(gram)
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    corr = gram / np.outer(scale, scale)
    kept: list[int] = []
    for j in range(k):
        if gram[j, j] <= 0:
            continue
        left = corr[j, j]
        if kept:
            sub = corr[np.ix_(kept, kept)]
            left -= corr[kept, j] @ np.linalg.solve(sub, corr[kept, j])
        if left > 1e-10:
            kept.append(j)
    inv = np.full((k, k), 0.0)
    if kept:
        inv[np.ix_(kept, kept)] = np.linalg.inv(corr[np.ix_(kept, kept)]) / np.outer(scale[kept], scale[kept])
    return inv, kept


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _cross_sums(prefix: str, k: int, weight: str = "", z: str = "z") -> list[Column]:
    """Sums of weight * z_i * z_j, written as SQL text: a hundred Column objects would cost more than the job."""
    return [F.expr(f"sum({weight}{z}{i} * {z}{j}) AS {prefix}{i}_{j}") for i, j in _pairs(k)]


def _square(row, prefix: str, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for i, j in _pairs(k):
        out[i, j] = out[j, i] = row[f"{prefix}{i}_{j}"]
    return out


def _collect(df: DataFrame, slices: Sequence[str]) -> dict[tuple, object]:
    """One row of sums per slice, on the driver: for models that are looked at one by one.

    ``many.ols`` keeps everything in tables, for any number of slices.
    """
    return {tuple(r[s] for s in slices): r for r in df.collect()}


def _unfitted(df: DataFrame, design: Design, models: dict, known: dict[tuple, str] | None = None) -> dict[tuple, str]:
    """Every slice of ``df`` without a model, with the reason."""
    if not design.slices:
        return {}
    reasons = {**design.problems, **(known or {})}
    seen = [tuple(r) for r in df.select(*design.slices).distinct().collect()]
    return {key: reasons.get(key, "no complete rows") for key in seen if key not in models}


@dataclass
class _Moments:
    """Per slice: count, means, centred cross products."""

    n: int
    shift: np.ndarray
    mean: np.ndarray
    gram: np.ndarray
    xy: np.ndarray
    ymean: float
    yy: float
    var_means: dict[str, float]


def _shifted(design: Design, table: SliceTable) -> list[Column]:
    """Design columns minus their approximate means, then the outcome likewise."""
    k = len(design.names)
    return [F.col(c) - table.get("__shift", i) for i, c in enumerate([*design.x, "__y"])][: k + 1]


def _shifts(design: Design) -> tuple[dict[tuple, list[float]], dict[tuple, object]]:
    vs = [c for c in design.rows.columns if c.startswith("__v_") and design.rows.schema[c].dataType.typeName() == "double"]
    aggs = [F.avg(c).alias(c) for c in [*design.x, "__y", *vs]]
    rows = _collect(
        design.rows.groupBy(*design.slices).agg(F.count(F.lit(1)).alias("n"), *aggs), design.slices
    )
    rows = {k: r for k, r in rows.items() if r["n"]}
    if not rows:
        raise ValueError("no complete rows to fit")
    return {k: [r[c] for c in [*design.x, "__y"]] for k, r in rows.items()}, rows


def _moments(design: Design) -> dict[tuple, _Moments]:
    """Counts, means and centred products from one pass: covariances are moments about the means that tasks combine pairwise."""
    k, columns = len(design.names), [*design.x, "__y"]
    vs = [c for c in design.rows.columns if c.startswith("__v_") and design.rows.schema[c].dataType.typeName() == "double"]
    sums = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in [*columns, *vs]]]
    sums += [F.expr(f"covar_pop({columns[i]}, {columns[j]}) * count(1) AS p{i}_{j}") for i, j in _pairs(k + 1)]
    out = {}
    for key, r in _collect(design.rows.groupBy(*design.slices).agg(*sums), design.slices).items():
        if r["n"]:
            mean, full = np.array([r[c] for c in columns]), _square(r, "p", k + 1)
            out[key] = _Moments(r["n"], mean, mean[:k], full[:k, :k], full[:k, k], mean[k], full[k, k], {c[4:]: r[c] for c in vs})
    if not out:
        raise ValueError("no complete rows to fit")
    return out


def _to_raw(mean: np.ndarray, slopes: np.ndarray, centre: float, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From (value at the mean, slopes) to (intercept, slopes)."""
    k = len(slopes)
    lift = np.eye(k + 1)
    lift[0, 1:] = -mean
    return lift @ np.concatenate([[centre], slopes]), lift @ cov @ lift.T


def _nan_dropped(fit: SliceFit, kept: Sequence[int]) -> SliceFit:
    for j, name in enumerate(fit.names[1:]):
        if j not in kept:
            fit.beta[j + 1] = np.nan
            fit.cov[j + 1, :] = fit.cov[:, j + 1] = np.nan
            fit.dropped.append(name)
    return fit


def _linear_stats(n: int, params: int, rss: float, tss: float) -> dict[str, float]:
    loglik = -n / 2 * (log(2 * pi) + log(rss / n) + 1) if rss > 0 else inf
    return {
        "nobs": n,
        "r2": 1 - rss / tss if tss > 0 else np.nan,
        "adj_r2": 1 - (rss / (n - params)) / (tss / (n - 1)) if n > params and tss > 0 else np.nan,
        "rmse": sqrt(rss / n),
        "loglik": loglik,
        "aic": -2 * loglik + 2 * params,
        "bic": -2 * loglik + log(n) * params,
    }


def _residual_sums(design: Design, centred: dict[tuple, list[float]], slopes: dict[tuple, list[float]], meat: bool):
    """Sum of squared residuals, and of e^2 z_i z_j with z_0 = 1."""
    k = len(design.names)
    table = SliceTable(design.rows, design.slices, {"__shift": centred, "__b": slopes})
    z = _shifted(design, table)
    fitted = sum((table.get("__b", i) * z[i] for i in range(k)), F.lit(0.0))
    one = [F.lit(1.0), *z[:k]]
    data = table.df.select(*design.slices, (z[k] - fitted).alias("e"), *[c.alias(f"z{i}") for i, c in enumerate(one)])
    sums = [F.expr("sum(e * e) AS rss")]
    if meat:
        sums += _cross_sums("m", k + 1, "e * e * ")
    return _collect(data.groupBy(*design.slices).agg(*sums), design.slices)


def ols(df: DataFrame, spec: Spec, slices: Sequence[str] = (), vcov: str = "iid") -> Fit:
    """Least squares; ``vcov`` is ``iid`` or ``HC1``.

    Rows are read three times at most: means, cross products, and residuals when
    the covariance is robust or the fit is nearly perfect.
    """
    if vcov not in ("iid", "HC1"):
        raise ValueError(vcov)
    design = build(df, spec, slices)
    moments, k = _moments(design), len(design.names)
    parts = {}
    for key, m in moments.items():
        inv, kept = _solve(m.gram, design.names)
        b = inv @ m.xy
        parts[key] = (inv, kept, b, m.yy - b @ m.xy)
    close = any(p[3] < 1e-6 * m.yy for p, m in zip(parts.values(), moments.values()))
    rows = {}
    if vcov == "HC1" or close:
        centred = {key: [*m.mean, m.ymean] for key, m in moments.items()}
        rows = _residual_sums(design, centred, {key: p[2] for key, p in parts.items()}, vcov == "HC1")
    models = {}
    for key, m in moments.items():
        inv, kept, b, rss = parts[key]
        if rows:
            rss = rows[key]["rss"]
        params = len(kept) + 1
        dof = m.n - params
        bread = np.zeros((k + 1, k + 1))
        bread[0, 0], bread[1:, 1:] = 1 / m.n, inv
        if dof <= 0:
            cov = np.full((k + 1, k + 1), np.nan)
        elif vcov == "HC1":
            cov = bread @ _square(rows[key], "m", k + 1) @ bread * (m.n / dof)
        else:
            cov = bread * (rss / dof)
        beta, cov = _to_raw(m.mean, b, m.ymean, cov)
        fit = SliceFit(
            ["(Intercept)", *design.names], beta, cov, m.n, dof, m.mean, m.var_means,
            _linear_stats(m.n, params, rss, m.yy), [],
        )
        models[key] = _nan_dropped(fit, kept)
    return Fit(spec, design.slices, "ols", models, design, _unfitted(df, design, models))


@dataclass
class FixedFit:
    """Fixed-effects fit: ``fit`` holds slopes; index 0 is the mean-level intercept."""

    fit: Fit
    groups: DataFrame


def ols_fixed(df: DataFrame, spec: Spec, group: str, slices: Sequence[str] = ()) -> FixedFit:
    """Least squares with one intercept per group.

    Within-group cross products are totals minus group-mean products, so rows are
    aggregated to groups (map-side first) and groups to slices; no window and no
    join back.  ``groups`` lists each group's intercept.  Index 0 of the
    coefficients is the intercept with groups at their observed proportions.
    """
    design = build(df, spec, slices, extra=[group])
    shifts, first = _shifts(design)
    k = len(design.names)
    table = SliceTable(design.rows, design.slices, {"__shift": shifts})
    z = _shifted(design, table)
    data = table.df.select(*design.slices, group, *[c.alias(f"z{i}") for i, c in enumerate(z)])
    sums = [F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(z{i}) AS s{i}") for i in range(k + 1)]]
    sums += _cross_sums("p", k + 1)
    by_group = data.groupBy(*design.slices, group).agg(*sums)
    within = [F.expr(f"sum(p{i}_{j} - s{i} * s{j} / n) AS w{i}_{j}") for i, j in _pairs(k + 1)]
    totals = [F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(k + 1)], f"p{k}_{k}"]]
    rows = _collect(
        by_group.groupBy(*design.slices).agg(F.count(F.lit(1)).alias("groups"), *totals, *within), design.slices
    )
    models, slopes = {}, {}
    for key, r in rows.items():
        n, w = r["n"], _square(r, "w", k + 1)
        mean = np.array(shifts[key]) + np.array([r[f"s{i}"] for i in range(k + 1)]) / n
        inv, kept = _solve(w[:k, :k], design.names)
        b = inv @ w[:k, k]
        rss = w[k, k] - b @ w[:k, k]
        params = len(kept) + r["groups"]
        dof = n - params
        sigma2 = rss / dof if dof > 0 else np.nan
        cov = np.zeros((k + 1, k + 1))
        cov[0, 0], cov[1:, 1:] = sigma2 / n, inv * sigma2
        beta, cov = _to_raw(mean[:k], b, mean[k], cov)
        tss = r[f"p{k}_{k}"] - r[f"s{k}"] ** 2 / n
        stats = _linear_stats(n, params, rss, tss) | {
            "r2_within": 1 - rss / w[k, k] if w[k, k] > 0 else np.nan,
            "groups": r["groups"],
        }
        var_means = {c[4:]: first[key][c] for c in first[key].asDict() if c.startswith("__v_")}
        fit = SliceFit(["(Intercept)", *design.names], beta, cov, n, dof, mean[:k], var_means, stats, [])
        models[key] = _nan_dropped(fit, kept)
        slopes[key] = b
    side = SliceTable(by_group, design.slices, {"__shift": shifts, "__b": slopes})
    level = side.get("__shift", k) + F.col(f"s{k}") / F.col("n")
    for i in range(k):
        level = level - side.get("__b", i) * (side.get("__shift", i) + F.col(f"s{i}") / F.col("n"))
    groups = side.df.select(*design.slices, group, F.col("n"), level.alias("intercept"))
    return FixedFit(Fit(spec, design.slices, "ols", models, design, _unfitted(df, design, models)), groups)


def _iterable(design: Design) -> Design:
    """The design on kept rows, for the passes of one iterative fit."""
    rows = design.rows
    numeric = [c for c in rows.columns if c.startswith("__v_") and rows.schema[c].dataType.typeName() == "double"]
    kept = rows.select(*design.slices, "__y", *design.x, *numeric).persist(StorageLevel.MEMORY_AND_DISK)
    return Design(design.spec, design.slices, design.names, kept, design.poly, design.booleans)


def logit(df: DataFrame, spec: Spec, slices: Sequence[str] = (), max_steps: int = 30, tol: float = 1e-9) -> Fit:
    """Logistic regression by Newton steps, one aggregate per step for all slices.

    The covariance is the inverse information.  Convergence is judged on the
    step, not on the deviance: under separation the deviance settles while the
    estimates run off.  The outcome is separated if a direction of the linear predictor puts no row on the wrong side of zero and some
    row off it; every pass tests the predictor and the last move, along which separated estimates run off.  A slice that is separated, has a constant outcome or does not converge
    is listed in ``unfitted``; without slices SeparationError is raised.
    """
    failed: dict[tuple, str] = {}

    def fail(key: tuple, reason: str) -> None:
        if not slices:
            raise SeparationError(reason)
        failed[key] = reason

    source = build(df, spec, slices)
    design = _iterable(source)
    k = len(design.names)
    try:
        moments = _moments(design)
        for key, m in moments.items():
            if not 0 < m.ymean < 1:
                fail(key, "the outcome is constant")
        moments = {key: m for key, m in moments.items() if key not in failed}
        scale, b, kept = {}, {}, {}
        for key, m in moments.items():
            _, kept[key] = _solve(m.gram, design.names)
            sd = np.sqrt(np.maximum(np.diag(m.gram) / m.n, 0))
            scale[key] = np.where(sd > 0, sd, 1.0)
            b[key] = np.zeros(k + 1)
            b[key][0] = log(m.ymean / (1 - m.ymean))
        centre = {key: [*m.mean, 0.0] for key, m in moments.items()}
        previous: dict[tuple, tuple[float, np.ndarray]] = {}
        moves = {key: np.zeros(k + 1) for key in b}
        done: set[tuple] = set()
        info, deviance = {}, {}
        for _ in range(max_steps if moments else 0):
            rows = _logit_sums(design, centre, scale, b, moves)
            for key, r in rows.items():
                if key in done or key in failed:
                    continue
                dev = r["dev"]
                sides = ((r["low"], r["high"], b[key]), (r["move_low"], r["move_high"], moves[key]))
                apart = next((v for low, high, v in sides if high > 1e-9 and low >= -SEPARATES * high), None)
                if apart is not None:
                    carry = [name for name, v in zip(["(Intercept)", *design.names], apart) if abs(v) > 1e-6 * np.max(np.abs(apart))]
                    fail(key, f"the outcome is separated by {', '.join(carry)}")
                    continue
                # A rise beyond rounding means the step overshot.
                if key in previous and dev > previous[key][0] * (1 + 1e-8) + 1e-8:
                    b[key] = (b[key] + previous[key][1]) / 2
                    continue
                hess = _square(r, "h", k + 1)
                grad = np.array([r[f"g{i}"] for i in range(k + 1)])
                use = [0, *[j + 1 for j in kept[key]]]
                inner = hess[np.ix_(use, use)]
                if not np.all(np.isfinite(inner)) or np.linalg.cond(inner) > 1e15:
                    fail(key, "the information matrix is singular")
                    continue
                inv = np.zeros((k + 1, k + 1))
                inv[np.ix_(use, use)] = np.linalg.inv(inner)
                move = inv @ grad
                info[key], deviance[key] = inv, dev
                if np.max(np.abs(move)) < tol * (1 + np.max(np.abs(b[key]))):
                    done.add(key)
                    continue
                previous[key], moves[key] = (dev, b[key]), move
                b[key] = b[key] + move
            if len(done) + sum(key in moments for key in failed) == len(moments):
                break
        for key in set(moments) - done - set(failed):
            fail(key, f"no estimate after {max_steps} steps")
    finally:
        design.rows.unpersist()
    models = {}
    for key, m in moments.items():
        if key in failed:
            continue
        unscale = np.diag([1.0, *(1 / scale[key])])
        beta, cov = _to_raw(m.mean, b[key][1:] / scale[key], b[key][0], unscale @ info[key] @ unscale)
        params = len(kept[key]) + 1
        loglik = -deviance[key] / 2
        null = m.n * (m.ymean * log(m.ymean) + (1 - m.ymean) * log1p(-m.ymean))
        stats = {
            "nobs": m.n, "loglik": loglik, "deviance": deviance[key], "pseudo_r2": 1 - loglik / null,
            "aic": -2 * loglik + 2 * params, "bic": -2 * loglik + log(m.n) * params,
        }
        fit = SliceFit(["(Intercept)", *design.names], beta, cov, m.n, inf, m.mean, m.var_means, stats, [])
        models[key] = _nan_dropped(fit, kept[key])
    return Fit(spec, source.slices, "logit", models, source, _unfitted(df, source, models, failed))


def _logit_sums(design: Design, centre, scale, b, moves):
    k = len(design.names)
    table = SliceTable(design.rows, design.slices, {"__c": centre, "__k": scale, "__b": b, "__m": moves})
    z = ["1D"] + [f"(({c} - {table.sql('__c', i)}) / {table.sql('__k', i)})" for i, c in enumerate(design.x)]
    linear, moved = (" + ".join(f"{table.sql(n, i)} * {z[i]}" for i in range(k + 1)) for n in ("__b", "__m"))
    data = table.df.selectExpr(
        *[f"`{s}`" for s in design.slices], "__y", *[f"{c} AS z{i}" for i, c in enumerate(z)], f"{linear} AS eta",
        f"(2 * __y - 1) * ({moved}) AS side",
    )
    # Both tails without overflow: p = 1 / (1 + exp(-eta)).
    p = 1 / (1 + F.exp(-F.col("eta")))
    data = data.withColumn("p", p).withColumn("w", F.col("p") * (1 - F.col("p")))
    eta, y = F.col("eta"), F.col("__y")
    dev = 2 * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - y * eta)
    sums = [F.sum(dev).alias("dev"), *[F.expr(f"sum(z{i} * (__y - p)) AS g{i}") for i in range(k + 1)]]
    sums += [F.expr(x) for x in ("min((2 * __y - 1) * eta) AS low", "max((2 * __y - 1) * eta) AS high", "min(side) AS move_low", "max(side) AS move_high")]
    sums += _cross_sums("h", k + 1, "w * ")
    return _collect(data.groupBy(*design.slices).agg(*sums), design.slices)


#: Bins of a bracket: with these a bracket of a tenth of the median mostly tells it in one pass.
_BINS = 1 << 16


def _bracket_bins(data: DataFrame, slices: Sequence[str]) -> DataFrame:
    """One row per slice: the bins of (slices, v, n, lo, hi) that hold the two middle ranks, as (bin, c, mn, mx)."""
    inside = "CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * {0}), {0} - 1) ELSE 0 END".format(_BINS)
    bins = data.groupBy(*slices, "n", F.expr(f"CASE WHEN v < lo THEN -1 WHEN v > hi THEN {_BINS} ELSE {inside} END").alias("bin"))
    bins = bins.agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx"))
    before = Window.partitionBy(*slices).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("below", F.coalesce(F.sum("c").over(before), F.lit(0)))

    def holder(rank: str) -> Column:
        return F.max(F.expr(f"CASE WHEN below <= {rank} AND {rank} < below + c THEN struct(bin, c, mn, mx) END"))

    return bins.groupBy(*slices).agg(holder("(n - 1) div 2").alias("one"), holder("n div 2").alias("two"))


def medians(df: DataFrame, slices: Sequence[str], value: Column, counts: dict[tuple, int], brackets: dict[tuple, tuple[float, float]] | None = None):
    """Exact median of ``value`` per slice, from counts in bins of a bracket.

    A pass counts values in equal bins of each slice's bracket and on either side of it, and tells the median once a middle bin holds a
    value alone, one value often, or two.  Else that bin, or the side that holds the middle, is the next bracket.  With brackets
    from a step before, one pass is mostly enough; without them a first one finds the ends.  One row per slice comes back from a pass.
    """
    data = df.select(*slices, value.alias("v"))
    if brackets is None:
        ends = _collect(data.groupBy(*slices).agg(F.min("v").alias("lo"), F.max("v").alias("hi")), slices)
        brackets = {k: (float(r["lo"]), float(r["hi"])) for k, r in ends.items()}
    found: dict[tuple, float] = {k: lo for k, (lo, hi) in brackets.items() if counts[k] == 1 and lo == hi}
    left = {k: b for k, b in brackets.items() if k not in found}
    while left:
        table = SliceTable(data, slices, {"__r": {k: [*b, counts[k]] for k, b in left.items()}})
        lo, hi, n = (table.get("__r", i) for i in range(3))
        values = table.df.select(*slices, "v", lo.alias("lo"), hi.alias("hi"), n.cast("long").alias("n"))
        for key, r in _collect(_bracket_bins(values, slices), slices).items():
            one, two = r["one"], r["two"]
            if one["bin"] != two["bin"]:
                found[key] = (one["mx"] + two["mn"]) / 2
            elif one["mn"] == one["mx"]:
                found[key] = one["mn"]
            elif one["c"] == 2 and counts[key] % 2 == 0:
                found[key] = (one["mn"] + one["mx"]) / 2
            else:
                left[key] = (one["mn"], one["mx"])
        left = {k: b for k, b in left.items() if k not in found}
    return found


def huber(
    df: DataFrame, spec: Spec, slices: Sequence[str] = (), k: float = HUBER_K, max_steps: int = 100, tol: float = 1e-4
) -> Fit:
    """Huber M-estimation by reweighted least squares from an OLS start.

    Each step takes the scale from the median absolute residual, weighs rows by
    min(1, k s / |e|) and solves again, until the residuals move by less than
    ``tol`` relative to their size.  Standard errors follow Huber (1981) with the
    finite-sample correction.
    """
    source = build(df, spec, slices)
    design = _iterable(source)
    q = len(design.names)
    try:
        moments = _moments(design)
        centre = {key: [*m.mean, m.ymean] for key, m in moments.items()}
        counts = {key: m.n for key, m in moments.items()}
        b, kept = {}, {}
        for key, m in moments.items():
            inv, kept[key] = _solve(m.gram, design.names)
            b[key] = np.concatenate([[0.0], inv @ m.xy])
        active, scale, steps = set(moments), {}, 0
        # At most half of all residuals are as large as sqrt(2) times their root mean square.
        brackets = {key: (0.0, 1.5 * sqrt(max(m.yy - b[key][1:] @ m.xy, 0.0) / m.n)) for key, m in moments.items()}
        while active and steps < max_steps:
            steps += 1
            data = _huber_rows(design, centre, b)
            meds = medians(data, design.slices, F.abs(F.col("e")), counts, {key: brackets[key] for key in active})
            for key in active:
                scale[key] = meds[key] / MAD_TO_SD
            active = {key for key in active if scale[key] > 0}
            rows = _huber_sums(design, centre, b, scale, k)
            for key in list(active):
                r, m = rows[key], moments[key]
                gram = _square(r, "h", q + 1)
                use = [0, *[j + 1 for j in kept[key]]]
                new = np.zeros(q + 1)
                new[use] = np.linalg.solve(gram[np.ix_(use, use)], np.array([r[f"g{i}"] for i in use]))
                # Residual change in closed form: z is centred, so cross terms with 1 vanish.
                delta = new - b[key]
                moved = m.n * delta[0] ** 2 + delta[1:] @ m.gram @ delta[1:]
                old = m.yy - 2 * b[key][1:] @ m.xy + b[key][1:] @ m.gram @ b[key][1:] + m.n * b[key][0] ** 2
                b[key] = new
                change = sqrt(max(moved, 0.0) / max(old, 1e-20))
                # The next median lies near this one.
                near = min(max(2 * change, 1e-3), 0.5)
                brackets[key] = (meds[key] * (1 - near), meds[key] * (1 + near))
                if change <= tol:
                    active.discard(key)
        ends = _huber_sums(design, centre, b, scale, k)
    finally:
        design.rows.unpersist()
    models = {}
    for key, m in moments.items():
        r, params = ends[key], len(kept[key]) + 1
        dof = m.n - params
        inv, _ = _solve(m.gram, design.names)
        bread = np.zeros((q + 1, q + 1))
        bread[0, 0], bread[1:, 1:] = 1 / m.n, inv
        share = r["core"] / m.n
        spread = share * (1 - share) * m.n / max(m.n - 1, 1)
        kappa = 1 + params * spread / (m.n * share**2) if share else np.nan
        sigma = sqrt(r["we2"] / dof) * kappa / share if dof > 0 and share else np.nan
        beta, cov = _to_raw(m.mean, b[key][1:], m.ymean + b[key][0], bread * sigma**2)
        stats = {"nobs": m.n, "scale": scale.get(key, 0.0), "sigma": sigma, "rmse": sqrt(r["rss"] / m.n),
                 "converged": float(key not in active)}
        fit = SliceFit(["(Intercept)", *design.names], beta, cov, m.n, inf, m.mean, m.var_means, stats, [])
        models[key] = _nan_dropped(fit, kept[key])
    return Fit(spec, source.slices, "huber", models, source, _unfitted(df, source, models))


def _huber_rows(design: Design, centre, b, extra=None) -> DataFrame:
    q = len(design.names)
    table = SliceTable(design.rows, design.slices, {"__c": centre, "__b": b, **(extra or {})})
    z = ["1D"] + [f"({c} - {table.sql('__c', i)})" for i, c in enumerate(design.x)]
    y = f"(__y - {table.sql('__c', q)})"
    fitted = " + ".join(f"{table.sql('__b', i)} * {z[i]}" for i in range(q + 1))
    more = [f"{table.sql(n, 0)} AS {n}" for n in (extra or {})]
    return table.df.selectExpr(
        *[f"`{s}`" for s in design.slices], f"{y} AS y", f"{y} - ({fitted}) AS e", *more, *[f"{c} AS z{i}" for i, c in enumerate(z)]
    )


def _huber_sums(design: Design, centre, b, scale, k: float):
    q = len(design.names)
    data = _huber_rows(design, centre, b, {"__scale": {key: [s] for key, s in scale.items()}})
    size, bound = F.abs(F.col("e")), F.col("__scale") * k
    data = data.withColumn("w", F.when(size <= bound, F.lit(1.0)).otherwise(bound / size))
    e, w = F.col("e"), F.col("w")
    sums = [F.sum(e * e).alias("rss"), F.sum(w * w * e * e).alias("we2"), F.count_if(size <= bound).alias("core")]
    sums += [F.expr(f"sum(w * z{i} * y) AS g{i}") for i in range(q + 1)] + _cross_sums("h", q + 1, "w * ")
    return _collect(data.groupBy(*design.slices).agg(*sums), design.slices)


def fit(df: DataFrame, spec: Spec, estimator: str = "ols", slices: Sequence[str] = (), **kw) -> Fit:
    """The same spec under another estimator: ``ols``, ``hc1``, ``logit`` or ``huber``."""
    if estimator == "hc1":
        return ols(df, spec, slices, vcov="HC1", **kw)
    return {"ols": ols, "logit": logit, "huber": huber}[estimator](df, spec, slices, **kw)

