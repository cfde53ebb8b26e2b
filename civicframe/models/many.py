"""Regressions for any number of slices, kept in tables from the rows to the coefficients.

Sums are one row per slice throughout, and the small systems of a batch of slices are solved at once as stacked arrays.  Nothing is
collected, and every slice of the input comes back: one that cannot be fitted has a status that says why.

Iterative fits shuffle the rows of small slices once: a slice becomes one row, and a task takes all steps of many slices side by side.  Slices
too large for that keep their rows apart and their state in a table; Spark adds up the sums of a step by slice, and slices that are done leave the loop.

Means and cross products come from one pass: Spark's covariances are central moments that tasks combine pairwise, so no
digits are lost and no row has to meet its slice's mean first.

All fits return slices, status, nobs, term, estimate, std_error, statistic, p_value, conf_low, conf_high.  ``status`` is ``ok``;
``dropped terms`` if some terms are explained by others (their estimates are null); ``no freedom`` if there are as many terms as rows
(no standard errors); ``no complete rows``; or a reason of the estimator's own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import pairwise
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import drop_folder, scratch_dir
from . import stacked
from .design import PolyConst, Spec, _numeric, part_columns, term_columns, term_names
from .regress import HUBER_K, MAD_TO_SD, SEPARATES, _cross_sums, _pairs

_FIELDS = ("estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high")
#: Slices of so many rows take their medians from Spark's exact percentile, larger ones by counts in bins of a bracket.
SMALL, BINS = 1024, 256
#: Iterative fits pack slices of at most so many numbers (rows times columns) into one row each; tasks fit so many numbers at a time.
PACKED, PIECE = 1024, 1 << 19


def _with_slice_values(df: DataFrame, side: DataFrame, slices: Sequence[str], how: str = "left") -> DataFrame:
    """Join of one row per slice; null slices match."""
    renamed = side.withColumnsRenamed({s: f"__s_{s}" for s in slices})
    same = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"__s_{s}")) for s in slices])
    return df.join(renamed, same, how).drop(*[f"__s_{s}" for s in slices])


def _poly_side(df: DataFrame, columns: Sequence[str], slices: Sequence[str]) -> DataFrame:
    """``__poly_<column>`` arrays of constants per slice (see ``design.poly_constants``); null where there is no polynomial."""
    sums, out = [], []
    for c in columns:
        present = F.when(~F.isnan(c), F.col(c))
        sums += [f(present).alias(f"__{n}_{c}") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop), ("g", F.skewness), ("k", F.kurtosis))]
        n, mean, var, skew, kurt = (F.col(f"__{x}_{c}") for x in ("n", "m", "v", "g", "k"))
        s2, s3, s4 = n * var, n * skew * F.pow(var, F.lit(1.5)), n * (kurt + 3) * var * var
        a = s3 / s2
        length2 = s4 - a * s3 - s2 * s2 / n
        constants = F.array(mean, a, s2 / n, F.sqrt(s2), F.when(length2 > 1e-12 * s4, F.sqrt(length2)))
        out.append(F.when(var > 0, constants).alias(f"__poly_{c}"))
    return df.groupBy(*slices).agg(*sums).select(*slices, *out)


@dataclass(frozen=True)
class _Shape:
    """Slice columns and term names: what tasks need to know of a model."""

    slices: list[str]
    names: list[str]


@dataclass
class _Model:
    """Data (slices, __group, x0 .. xk with the outcome last), its rows without nulls, and all slices.

    Slice columns have names of their own here, which no column of a step can clash with.
    """

    shape: _Shape
    data: DataFrame
    rows: DataFrame
    every: DataFrame
    schema: T.StructType
    outer: list[str]

    def named(self, found: DataFrame) -> DataFrame:
        return found.withColumnsRenamed(dict(zip(self.slices, self.outer)))

    @property
    def slices(self) -> list[str]:
        return self.shape.slices

    @property
    def k(self) -> int:
        return len(self.shape.names) - 1


def _model(df: DataFrame, spec: Spec, outer: Sequence[str], group: str | None = None) -> _Model:
    slices = [f"__k{i}" for i in range(len(outer))]
    keys = [F.col(s).alias(k) for s, k in zip(outer, slices)]
    extra = ["__group"] if group else []
    used = list(dict.fromkeys([spec.outcome, *spec.columns()]))
    data, booleans = _numeric(df.select(*keys, *[F.col(group).alias(g) for g in extra], *used), spec)
    every = data.select(*slices).distinct()
    polys = list(dict.fromkeys(p.column for p in spec.polys()))
    if polys:
        data = _with_slice_values(data, _poly_side(data, polys, slices), slices)

    def cols_of(part) -> list[Column]:
        return part_columns(part, F.col, lambda p: [F.get(F.col(f"__poly_{p.column}"), F.lit(j)) for j in range(PolyConst.WIDTH)])

    x = [c for t in spec.terms for c in term_columns(t, cols_of)]
    names = ["(Intercept)", *[n for t in spec.terms for n in term_names(t, booleans)]]
    columns = [c.alias(f"x{i}") for i, c in enumerate([*x, F.col(spec.outcome)])]
    data = data.select(*slices, *extra, *columns)
    rows = data.dropna(subset=[f"x{i}" for i in range(len(names))])
    schema = T.StructType([T.StructField(k, df.schema[s].dataType) for s, k in zip(outer, slices)])
    return _Model(_Shape(slices, names), data, rows, every, schema, list(outer))


def _moments(rows: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """n, means and centred products (upper triangle) of x0 .. xk, in one pass."""
    means = F.array(*[F.avg(f"x{i}") for i in range(k + 1)]).alias("means")
    products = F.expr("array(" + ", ".join(f"covar_pop(x{i}, x{j}) * count(1)" for i, j in _pairs(k + 1)) + ")").alias("products")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), means, products)


def _numbers(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """An array column of one width as a matrix; a null row is NaN."""
    column = batch.column(name)
    out = np.full((len(column), width), np.nan)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, max(1, width), dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32)), pa.array(values.ravel()))


def _tidy_schema(model: _Model) -> T.StructType:
    schema = T.StructType([*model.schema.fields]).add("status", "string").add("nobs", "long").add("term", "string")
    for f in _FIELDS:
        schema = schema.add(f, "double")
    return schema


def _tidy(batch: pa.RecordBatch, shape: _Shape, status: np.ndarray, n: np.ndarray, estimates: np.ndarray, ses: np.ndarray, df: np.ndarray, level: float) -> pa.RecordBatch:
    """Rows of terms; a NaN is a null."""
    count, width = estimates.shape
    usable = ses > 0
    with np.errstate(invalid="ignore", divide="ignore"):
        t = np.where(usable, estimates / ses, np.nan)
    p = stacked.two_sided(t.ravel(), np.repeat(df, width))
    reach = ses * stacked.criticals(level, df)[:, None]
    reach = np.where(usable, reach, np.nan)
    place = pa.array(np.repeat(np.arange(count), width))
    numbers = [estimates, ses, t, p.reshape(count, width), estimates - reach, estimates + reach]
    columns = [batch.column(s).take(place) for s in shape.slices]
    columns += [pa.array(status, pa.string()).take(place), pa.array(n.astype(np.int64)).take(place), pa.array(shape.names * count, pa.string())]
    columns += [pa.array(x.ravel(), mask=np.isnan(x.ravel())) for x in numbers]
    return pa.RecordBatch.from_arrays(columns, [*shape.slices, "status", "nobs", "term", *_FIELDS])


def _linear(batch: pa.RecordBatch, k: int, used: np.ndarray | float = 1.0):
    """Least squares of a batch of moments: n, means, slopes, inverse, kept, residual sum, freedom, status; NaN without rows."""
    n = batch.column("n").cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    means = _numbers(batch, "means", k + 1)
    full = stacked.symmetric(np.nan_to_num(_numbers(batch, "products", (k + 1) * (k + 2) // 2)), k + 1)
    inverse, kept = stacked.inverses(full[:, :k, :k])
    b = np.einsum("nij,nj->ni", inverse, full[:, :k, k])
    rss = np.maximum(0.0, full[:, k, k] - np.einsum("ni,ni->n", b, full[:, :k, k]))
    freedom = n - kept.sum(axis=1) - used
    status = np.where(n == 0, "no complete rows", np.where(kept.sum(axis=1) < k, "dropped terms", np.where(freedom > 0, "ok", "no freedom")))
    return n, means, b, inverse, kept, rss, freedom, status


def _bread(n: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Inverse cross products of (1, centred terms)."""
    count, k, _ = inverse.shape
    out = np.zeros((count, k + 1, k + 1))
    out[:, 0, 0], out[:, 1:, 1:] = 1 / np.maximum(n, 1), inverse
    return out


def _hidden(values: np.ndarray, kept: np.ndarray, n: np.ndarray) -> np.ndarray:
    """NaN for the terms left out, and for slices without rows."""
    there = np.concatenate([np.ones((len(kept), 1), bool), kept], axis=1) & (n > 0)[:, None]
    return np.where(there, values, np.nan)


def _classical(model: _Model, table: DataFrame, level: float, used=lambda batch: 1.0) -> DataFrame:
    k, shape = model.k, model.shape

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, means, b, inverse, kept, rss, freedom, status = _linear(batch, k, used(batch))
            with np.errstate(invalid="ignore", divide="ignore"):
                sigma2 = np.where(freedom > 0, rss / freedom, np.nan)
            estimates, variances = stacked.from_centre(means[:, :k], means[:, k], b, _bread(n, inverse) * sigma2[:, None, None])
            ses = np.sqrt(np.maximum(variances, 0))
            yield _tidy(batch, shape, status, n, _hidden(estimates, kept, n), _hidden(ses, kept, n), freedom, level)

    return model.named(table.mapInArrow(solve, _tidy_schema(model)))


def ols(df: DataFrame, spec: Spec, slices: Sequence[str], level: float = 0.95) -> DataFrame:
    """Least squares; a polynomial without enough distinct values leaves a slice without complete rows."""
    model = _model(df, spec, slices)
    table = _with_slice_values(model.every, _moments(model.rows, model.slices, model.k), model.slices)
    return _classical(model, table, level)


def fixed(df: DataFrame, spec: Spec, group: str, slices: Sequence[str], level: float = 0.95) -> DataFrame:
    """Least squares with one intercept per group (null is a group); the intercept is that of groups at their observed proportions.

    Within-group products are central moments of the groups, so rows are summed to groups and groups to slices.
    """
    model = _model(df, spec, slices, group)
    by_group = _moments(model.rows, [*model.slices, "__group"], model.k)
    width = len(_pairs(model.k + 1))
    means = [f"sum(n * means[{i}]) / sum(n)" for i in range(model.k + 1)]
    within = [f"sum(products[{i}])" for i in range(width)]
    sums = by_group.groupBy(*model.slices).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.expr(f"array({', '.join(means)})").alias("means"),
        F.expr(f"array({', '.join(within)})").alias("products"),
    )
    table = _with_slice_values(model.every, sums, model.slices)
    return _classical(model, table, level, lambda batch: batch.column("groups").cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False))


def _state_schema(model: _Model, fields: dict[str, str]) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in model.schema.fields], *[f"{n} {t}" for n, t in fields.items()]])


def _centred(rows: DataFrame, state: DataFrame, model: _Model, more: Sequence[str] = ()) -> DataFrame:
    """Rows of the state's slices with z0 = 1 and zi, terms less their means over their scales, and zk+1, the outcome."""
    z = ["1D AS z0", *[f"(x{i} - centre[{i}]) / scales[{i}] AS z{i + 1}" for i in range(model.k)], f"x{model.k} AS y"]
    joined = _with_slice_values(rows, state, model.slices, "inner")
    return joined.selectExpr(*[f"`{s}`" for s in model.slices], *z, *more)


def hc1(df: DataFrame, spec: Spec, slices: Sequence[str], level: float = 0.95) -> DataFrame:
    """Least squares with the HC1 covariance: rows meet their slice's coefficients once more for the squared residuals."""
    model = _model(df, spec, slices)
    k, slices, shape = model.k, model.slices, model.shape
    table = _with_slice_values(model.every, _moments(model.rows, slices, k), slices)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, means, b, *_ = _linear(batch, k)
            lists = [_lists(np.concatenate([means[:, k:], b], axis=1)), _lists(means[:, :k]), _lists(np.ones((len(b), max(k, 1))))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*slices, "n", "means", "products"]], *lists], names)

    names = [*slices, "n", "means", "products", "b", "centre", "scales"]
    kinds = {"n": "long", "means": "array<double>", "products": "array<double>", "b": "array<double>", "centre": "array<double>", "scales": "array<double>"}
    state = _written(table.mapInArrow(solve, _state_schema(model, kinds)))
    rows = _centred(model.rows, state.where("n IS NOT NULL").select(*slices, "b", "centre", "scales"), model, ["b"])
    fitted = " + ".join(f"b[{i}] * z{i}" for i in range(k + 1))
    rows = rows.withColumn("e", F.expr(f"y - ({fitted})"))
    meat = rows.groupBy(*slices).agg(*_cross_sums("m", k + 1, "e * e * "))
    meat = meat.select(*slices, F.array(*[f"m{i}_{j}" for i, j in _pairs(k + 1)]).alias("meat"))
    both = _with_slice_values(state.select(*slices, "n", "means", "products"), meat, slices)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, means, b, inverse, kept, _, freedom, status = _linear(batch, k)
            bread = _bread(n, inverse)
            middle = stacked.symmetric(np.nan_to_num(_numbers(batch, "meat", len(_pairs(k + 1)))), k + 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                cov = bread @ middle @ bread * np.where(freedom > 0, n / freedom, np.nan)[:, None, None]
            estimates, variances = stacked.from_centre(means[:, :k], means[:, k], b, cov)
            ses = np.sqrt(np.maximum(variances, 0))
            yield _tidy(batch, shape, status, n, _hidden(estimates, kept, n), _hidden(ses, kept, n), freedom, level)

    return model.named(both.mapInArrow(finish, _tidy_schema(model)))


#: State of an iterative fit: what a step needs, and the result once ``status`` is there.
_LOGIT = {
    "n": "long", "centre": "array<double>", "scales": "array<double>", "kept": "array<double>", "b": "array<double>", "move": "array<double>",
    "last_b": "array<double>", "last_dev": "double", "steps": "int", "status": "string", "estimates": "array<double>", "ses": "array<double>",
    "separates": "array<double>",
}


def _rebuilt(batch: pa.RecordBatch, shape: _Shape, kinds: dict[str, str], new: dict[str, object]) -> pa.RecordBatch:
    """The batch's slices and state columns, some of them replaced."""
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    columns = [batch.column(s) for s in shape.slices]
    for name, kind in kinds.items():
        value = new.get(name)
        if value is None:
            columns.append(batch.column(name))
        elif kind.startswith("array"):
            columns.append(_lists(value))
        else:
            columns.append(pa.array(value, types[kind], from_pandas=kind == "double"))
    return pa.RecordBatch.from_arrays(columns, [*shape.slices, *kinds])


def _with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: Spark then knows its size, so that a small state is broadcast to the rows."""
    spark, folder = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _looped(state: DataFrame, step, max_steps: int) -> DataFrame:
    """Steps until no slice lacks a status; slices that have one are set aside, and what a step leaves open goes once the next is written."""
    spark, folder = state.sparkSession, scratch_dir(state.sparkSession)
    schema = T.StructType([*state.schema.fields, T.StructField("step", T.IntegerType()), T.StructField("over", T.BooleanType())])
    for i in range(max_steps + 1):
        state.withColumn("over", F.col("status").isNotNull()).write.partitionBy("over").parquet(f"{folder}/step={i}")
        if i:
            drop_folder(spark, f"{folder}/step={i - 1}/over=false")
        state = spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/step={i}").where("NOT over").drop("step", "over")
        if state.isEmpty():
            break
        if i < max_steps:
            state = step(state)
    every = spark.read.schema(schema).parquet(folder).drop("step", "over")
    return every.withColumn("status", F.coalesce("status", F.lit("not decided")))


def _by_size(model: _Model) -> tuple[DataFrame, _Model | None]:
    """The small slices, one row each with the numbers of their complete rows, and the model of the large ones, if there are any.

    The slices are counted first, so that no row holds more than ``PACKED`` numbers.
    """
    slices, w = model.slices, model.k + 1
    data = _written(model.data)
    whole = " AND ".join(f"nanvl(CAST(x{i} AS DOUBLE), NULL) IS NOT NULL" for i in range(w))
    counts = data.groupBy(*slices).agg(F.count_if(F.expr(whole)).alias("n"))
    large = _written(counts.where(F.col("n") * w > PACKED).select(*slices))
    some = not large.isEmpty()
    small = _with_slice_values(data, large, slices, "left_anti") if some else data
    numbers = f"CASE WHEN {whole} THEN array({', '.join(f'CAST(x{i} AS DOUBLE)' for i in range(w))}) END"
    packed = small.groupBy(*slices).agg(F.flatten(F.collect_list(F.expr(numbers))).alias("numbers"))
    if not some:
        return packed, None
    rows = _written(_with_slice_values(data, large, slices, "left_semi").dropna(subset=[f"x{i}" for i in range(w)]))
    return packed, replace(model, data=rows, rows=rows, every=large)


def _sums(values: np.ndarray, n: np.ndarray, add=np.add) -> np.ndarray:
    """Sums (or ``add``) of consecutive rows, ``n`` of them for each slice; zeros where there are none."""
    out = np.zeros((len(n), *values.shape[1:]))
    there = n > 0
    if there.any():
        out[there] = add.reduceat(values, (np.cumsum(n) - n)[there], axis=0)
    return out


def _middles(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Medians of consecutive values, at least one for each slice."""
    ordered = values[np.lexsort((values, np.repeat(np.arange(len(n)), n)))]
    first = np.cumsum(n) - n
    return (ordered[first + (n - 1) // 2] + ordered[first + n // 2]) / 2


def _products(z: np.ndarray, weights: np.ndarray | float = 1.0) -> np.ndarray:
    """Products of all pairs of columns (upper triangle), row by row."""
    return np.stack([weights * z[:, i] * z[:, j] for i, j in _pairs(z.shape[1])], axis=1)


def _packed_fits(batches: Iterator[pa.RecordBatch], shape: _Shape, size: int, max_steps: int, start, step, finish) -> Iterator[pa.RecordBatch]:
    """All steps of the slices of each batch, cut into pieces of about ``size`` numbers: the same ``start`` and ``finish`` as for tables, and
    ``step`` over the rows at hand.

    ``step`` and ``finish`` get the state, the rows (1, centred terms), the outcome and the number of rows of each slice.
    """
    w = len(shape.names)
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("numbers")).to_numpy(zero_copy_only=False))
        cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, size)[1:], side="right")
        for low, high in pairwise(np.unique([0, *cuts, len(ends)])):
            piece = batch.slice(low, high - low)
            n = pc.list_value_length(piece.column("numbers")).to_numpy(zero_copy_only=False).astype(np.int64) // w
            x = piece.column("numbers").flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
            # Means and products from differences to a slice's first row, which are zero where a column is constant.
            origin = x[np.minimum(np.cumsum(n) - n, max(len(x) - 1, 0))] if len(x) else np.zeros((len(n), w))
            away = x - np.repeat(origin, n, axis=0)
            mean = _sums(away, n) / np.maximum(n, 1)[:, None]
            products = _sums(_products(away - np.repeat(mean, n, axis=0)), n)
            means = np.where(n[:, None] > 0, origin + mean, np.nan)
            odd = _sums(((x[:, -1] != 0) & (x[:, -1] != 1)).astype(float), n).astype(np.int64)
            columns = [*[piece.column(s) for s in shape.slices], pa.array(n), _lists(means), _lists(products), pa.array(odd)]
            state = next(start(iter([pa.RecordBatch.from_arrays(columns, [*shape.slices, "n", "means", "products", "odd"])])))
            centre, scales = _numbers(state, "centre", w - 1), _numbers(state, "scales", w - 1)
            terms = (x[:, :-1] - np.repeat(centre, n, axis=0)) / np.repeat(scales, n, axis=0)
            z, y = np.concatenate([np.ones((len(x), 1)), terms], axis=1), x[:, -1]
            for i in range(max_steps + 1):
                over = state.column("status").is_valid().to_numpy(zero_copy_only=False) | (i == max_steps)
                rows = np.repeat(over, n)
                if over.any():
                    yield from finish(state.filter(pa.array(over)), z[rows], y[rows], n[over])
                if over.all():
                    break
                state, z, y, n = state.filter(pa.array(~over)), z[~rows], y[~rows], n[~over]
                state = step(state, z, y, n)


def _texts(values: Sequence[str | None]) -> list[str | None]:
    return [v or None for v in values]


def logit(df: DataFrame, spec: Spec, slices: Sequence[str], level: float = 0.95, max_steps: int = 200, tol: float = 1e-9) -> DataFrame:
    """Logistic regression by weighted least-squares steps, with an exact test for separation; one more column, ``separates``.

    An outcome is separated if some direction of the linear predictor puts no row on the wrong side of zero and some row off it.  Under
    separation the steps run along such a direction.  So every step tests its predictor and its move: the sum of a pass holds
    the furthest row on either side.  A slice is ``separated`` only with such a direction in hand (``separates`` marks the terms that
    carry it), and ``ok`` only once its steps vanish, which no separated slice's do; the number of steps decides neither.
    Other reasons: ``the outcome is constant``, ``the outcome is not 0 or 1``.
    """
    model = _model(df, spec, slices)
    k, slices, w, shape = model.k, model.slices, model.k + 1, model.shape

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, means, _, _, kept, *_ = _linear(batch, k)
            count = len(n)
            full = stacked.symmetric(np.nan_to_num(_numbers(batch, "products", (k + 1) * (k + 2) // 2)), k + 1)
            sd = np.sqrt(np.einsum("nii->ni", full)[:, :k] / np.maximum(n, 1)[:, None])
            mean = means[:, k]
            odd = batch.column("odd").fill_null(0).to_numpy(zero_copy_only=False) > 0
            constant = ~((mean > 0) & (mean < 1))
            status = np.where(n == 0, "no complete rows", np.where(odd, "the outcome is not 0 or 1", np.where(constant, "the outcome is constant", "")))
            b = np.zeros((count, w))
            safe = np.where(constant | odd, 0.5, mean)
            b[:, 0] = np.log(safe / (1 - safe))
            nothing = np.full((count, w), np.nan)
            new = {
                "centre": np.nan_to_num(means[:, :k]), "scales": np.where(sd > 0, sd, 1.0), "kept": kept.astype(float), "b": b, "move": nothing,
                "last_b": nothing, "last_dev": np.full(count, np.nan), "steps": np.zeros(count, np.int32), "status": _texts(status),
                "estimates": nothing, "ses": nothing, "separates": nothing, "n": n.astype(np.int64),
            }
            yield _rebuilt(batch, shape, _LOGIT, new)

    def step(state: DataFrame) -> DataFrame:
        data = _centred(large.rows, state.select(*slices, "centre", "scales", "b", "move"), model, ["b", "move"])
        eta = " + ".join(f"b[{i}] * z{i}" for i in range(w))
        move = " + ".join(f"move[{i}] * z{i}" for i in range(w))
        data = data.selectExpr(*[f"`{s}`" for s in slices], *[f"z{i}" for i in range(w)], "y", f"{eta} AS eta", f"(2 * y - 1) * ({move}) AS side")
        data = data.withColumn("p", F.expr("1 / (1 + exp(-eta))")).withColumn("w", F.expr("p * (1 - p)"))
        sums = ["2 * sum(greatest(eta, 0D) + log1p(exp(-abs(eta))) - y * eta) AS dev"]
        sums += ["min((2 * y - 1) * eta) AS low", "max((2 * y - 1) * eta) AS high", "min(side) AS move_low", "max(side) AS move_high"]
        sums += [f"array({', '.join(f'sum(z{i} * (y - p))' for i in range(w))}) AS g"]
        sums += [f"array({', '.join(f'sum(w * z{i} * z{j})' for i, j in _pairs(w))}) AS h"]
        found = data.groupBy(*slices).agg(*[F.expr(s) for s in sums])
        return _with_slice_values(state, found, slices).mapInArrow(update, _state_schema(model, _LOGIT))

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("dev", "low", "high", "move_low", "move_high", "last_dev", "n", "steps")}
            b, move, last_b, g, kept = (_numbers(batch, c, x) for c, x in (("b", w), ("move", w), ("last_b", w), ("g", w), ("kept", k)))
            centre, scales = _numbers(batch, "centre", k), _numbers(batch, "scales", max(k, 0))
            with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                back = one["dev"] > one["last_dev"] * (1 + 1e-8) + 1e-8  # the step overshot
                by_b = (one["high"] > 1e-9) & (one["low"] >= -SEPARATES * one["high"])
                by_move = (one["move_high"] > 1e-9) & (one["move_low"] >= -SEPARATES * one["move_high"])
            separated = by_b | by_move
            use = np.concatenate([np.ones((len(b), 1), bool), kept > 0], axis=1)
            hess = stacked.symmetric(np.nan_to_num(_numbers(batch, "h", len(_pairs(w))), posinf=0.0), w)
            hess = np.where(use[:, :, None] & use[:, None, :], hess, 0.0)
            inverse, solved = stacked.inverses(hess, 1e-15)
            step = np.einsum("nij,nj->ni", inverse, np.where(use, g, 0.0))
            stuck = (solved != use).any(axis=1) | ~np.isfinite(step).all(axis=1)
            still = np.abs(step).max(axis=1) < tol * (1 + np.abs(b).max(axis=1))
            done = still & ~separated & ~back & ~stuck
            direction = np.abs(np.where(by_b[:, None], b, np.nan_to_num(move)))
            carries = direction > 1e-6 * direction.max(axis=1, keepdims=True)
            unscale = np.concatenate([np.ones((len(b), 1)), 1 / scales], axis=1) if k else np.ones((len(b), 1))
            cov = inverse * unscale[:, :, None] * unscale[:, None, :]
            estimates, variances = stacked.from_centre(centre, b[:, 0], (b * unscale)[:, 1:], cov)
            hidden = ~(done[:, None] & use)
            fine = np.where(kept.sum(axis=1) < k, "dropped terms", "ok")
            status = np.where(separated, "separated", np.where(back, "", np.where(stuck, "no estimate", np.where(done, fine, ""))))
            go = ~back[:, None]
            with np.errstate(invalid="ignore"):
                new = {
                    "b": np.where(go, b + np.where(np.isfinite(step), step, 0.0), (b + last_b) / 2), "move": np.where(go, step, move), "last_b": np.where(go, b, last_b),
                    "last_dev": np.where(back, one["last_dev"], one["dev"]), "steps": one["steps"].astype(np.int32) + 1, "status": _texts(status),
                    "estimates": np.where(hidden, np.nan, estimates), "ses": np.where(hidden, np.nan, np.sqrt(np.maximum(variances, 0))),
                    "separates": np.where(separated[:, None], carries.astype(float), np.nan),
                }
            yield _rebuilt(batch, shape, _LOGIT, new)

    def packed_step(state: pa.RecordBatch, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        b, move = (np.repeat(_numbers(state, c, w), n, axis=0) for c in ("b", "move"))
        with np.errstate(invalid="ignore", over="ignore"):
            eta, toward = np.einsum("ni,ni->n", b, z), np.einsum("ni,ni->n", move, z)
            p = 1 / (1 + np.exp(-eta))
            dev = 2 * _sums(np.maximum(eta, 0) + np.log1p(np.exp(-np.abs(eta))) - y * eta, n)
            g, h = _sums(z * (y - p)[:, None], n), _sums(_products(z, p * (1 - p)), n)
            sides = {"": (2 * y - 1) * eta, "move_": (2 * y - 1) * toward}
        found = {"dev": pa.array(dev), "g": _lists(g), "h": _lists(h)}
        for name, side in sides.items():
            found |= {f"{name}low": pa.array(_sums(side, n, np.minimum)), f"{name}high": pa.array(_sums(side, n, np.maximum))}
        return next(update(iter([_with_columns(state, found)])))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            status = np.array([s or "not decided" for s in batch.column("status").to_pylist()], object)
            tidy = _tidy(batch, shape, status, n, _numbers(batch, "estimates", w), _numbers(batch, "ses", w), np.full(len(n), inf), level)
            marks = _numbers(batch, "separates", w).ravel()
            yield tidy.append_column("separates", pa.array(marks > 0, mask=np.isnan(marks)))

    def packed_fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed_fits(batches, shape, PIECE, max_steps, start, packed_step, lambda state, z, y, n: finish(iter([state])))

    schema = _tidy_schema(model).add("separates", "boolean")
    packed, large = _by_size(model)
    fits = packed.mapInArrow(packed_fits, schema)
    if large:
        outcome = F.count_if((F.col(f"x{k}") != 0) & (F.col(f"x{k}") != 1)).alias("odd")
        table = _with_slice_values(_moments(large.rows, slices, k), large.rows.groupBy(*slices).agg(outcome), slices)
        found = _looped(table.mapInArrow(start, _state_schema(model, _LOGIT)), step, max_steps)
        fits = fits.unionByName(found.mapInArrow(finish, schema))
    return model.named(fits)


_HUBER = {
    "n": "long", "centre": "array<double>", "scales": "array<double>", "kept": "array<double>", "b": "array<double>", "means": "array<double>",
    "products": "array<double>", "lo": "double", "hi": "double", "scale": "double", "steps": "int", "status": "string",
}


def _medians(values: DataFrame, slices: Sequence[str]) -> DataFrame:
    """``median`` of v per slice from one pass, exact where it is not null; else the narrower bracket ``new_lo``, ``new_hi`` that holds it.

    ``values`` has n, lo and hi of its slice beside v.  Values of large slices are counted in bins of the bracket and on either side of
    it; a bin that holds the middle alone, or with one other value, tells the median.
    """
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    inside = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
    bin_ = F.when(F.col("n") <= SMALL, 0).when(v < lo, -1).when(v > hi, BINS).otherwise(inside)
    counts = values.groupBy(*slices, bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx"), F.first("n").alias("n"),
        F.percentile(F.when(F.col("n") <= SMALL, v), 0.5).alias("exact"),
    )
    before = Window.partitionBy(*slices).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below", F.coalesce(F.sum("c").over(before), F.lit(0)))

    def holder(rank: str) -> Column:
        return F.max(F.when(F.expr(f"below <= {rank} AND {rank} < below + c"), F.struct("bin", "c", "mn", "mx")))

    found = counts.groupBy(*slices).agg(holder("(n - 1) div 2").alias("one"), holder("n div 2").alias("two"), F.max("exact").alias("exact"), F.first("n").alias("n"))
    median = F.expr("""CASE WHEN exact IS NOT NULL THEN exact
        WHEN one.bin <> two.bin THEN (one.mx + two.mn) / 2
        WHEN one.mn = one.mx OR one.c = 1 THEN one.mn
        WHEN one.c = 2 AND n % 2 = 0 THEN (one.mn + one.mx) / 2 END""")
    return found.select(*slices, median.alias("median"), F.col("one.mn").alias("new_lo"), F.col("one.mx").alias("new_hi"))


def huber(
    df: DataFrame, spec: Spec, slices: Sequence[str], level: float = 0.95, k: float = HUBER_K, max_steps: int = 100, tol: float = 1e-4
) -> DataFrame:
    """Huber M-estimation by reweighted least squares from a least-squares start (see ``regress.huber``).

    A step over tables takes two passes: the median absolute residual, whose bracket is carried from step to step (a slice whose
    median left its bracket narrows it again while others go on), then the weighted sums.  ``not converged`` marks slices that were still
    moving after ``max_steps`` steps; slices with ``no freedom`` keep their least-squares start.
    """
    model = _model(df, spec, slices)
    q, slices, w, shape = model.k, model.slices, model.k + 1, model.shape

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, means, b, _, kept, rss, freedom, _ = _linear(batch, q)
            count, none = len(n), np.zeros(len(n))
            new = {
                "n": n.astype(np.int64), "centre": np.nan_to_num(means[:, :q]), "scales": np.ones((count, q)), "kept": kept.astype(float),
                "b": np.concatenate([np.nan_to_num(means[:, q:]), b], axis=1), "means": np.nan_to_num(means),
                "products": np.nan_to_num(_numbers(batch, "products", (q + 1) * (q + 2) // 2)),
                # At most half of all residuals are as large as sqrt(2) times their root mean square.
                "lo": none, "hi": 1.5 * np.sqrt(rss / np.maximum(n, 1)), "scale": none, "steps": none.astype(np.int32),
                "status": _texts(np.where(n == 0, "no complete rows", np.where(freedom <= 0, "no freedom", ""))),
            }
            yield _rebuilt(batch, shape, _HUBER, new)

    def residuals(state: DataFrame, more: Sequence[str]) -> DataFrame:
        data = _centred(large.rows, state.select(*slices, "centre", "scales", "b", *more), model, ["b", *more])
        return data.withColumn("e", F.expr("y - (" + " + ".join(f"b[{i}] * z{i}" for i in range(w)) + ")"))

    def step(state: DataFrame) -> DataFrame:
        values = residuals(state, ["n", "lo", "hi"]).select(*slices, F.abs("e").alias("v"), "n", "lo", "hi")
        state = _written(_with_slice_values(state, _medians(values, slices), slices))
        waiting = state.where("median IS NULL").withColumns({"lo": F.col("new_lo"), "hi": F.col("new_hi")}).select(*slices, *_HUBER)
        ready = state.where("median IS NOT NULL").withColumn("scale", F.col("median") / MAD_TO_SD)
        data = residuals(ready.where("scale > 0"), ["scale"])
        data = data.withColumn("w", F.expr(f"CASE WHEN abs(e) <= scale * {k} THEN 1D ELSE scale * {k} / abs(e) END"))
        sums = [f"array({', '.join(f'sum(w * z{i} * y)' for i in range(w))}) AS g", f"array({', '.join(f'sum(w * z{i} * z{j})' for i, j in _pairs(w))}) AS h"]
        found = data.groupBy(*slices).agg(*[F.expr(s) for s in sums])
        moved = _with_slice_values(ready, found, slices).mapInArrow(update, _state_schema(model, _HUBER))
        return moved.unionByName(waiting)

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, kept, g, means = _numbers(batch, "b", w), _numbers(batch, "kept", q) > 0, _numbers(batch, "g", w), _numbers(batch, "means", w)
            one = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "scale", "median", "steps")}
            flat = one["scale"] <= 0
            use = np.concatenate([np.ones((len(b), 1), bool), kept], axis=1)
            h = stacked.symmetric(np.nan_to_num(_numbers(batch, "h", len(_pairs(w)))), w)
            inverse, _ = stacked.inverses(np.where(use[:, :, None] & use[:, None, :], h, 0.0), 1e-14)
            new_b = np.where(flat[:, None], b, np.einsum("nij,nj->ni", inverse, np.nan_to_num(np.where(use, g, 0.0))))
            full = stacked.symmetric(_numbers(batch, "products", len(_pairs(w))), w)
            gram, xy, yy = full[:, :q, :q], full[:, :q, q], full[:, q, q]
            delta = new_b - b
            moved = one["n"] * delta[:, 0] ** 2 + np.einsum("ni,nij,nj->n", delta[:, 1:], gram, delta[:, 1:])
            slopes, off = b[:, 1:], b[:, 0] - means[:, q]
            old = yy - 2 * np.einsum("ni,ni->n", slopes, xy) + np.einsum("ni,nij,nj->n", slopes, gram, slopes) + one["n"] * off**2
            change = np.sqrt(np.maximum(moved, 0) / np.maximum(old, 1e-20))
            steps = one["steps"] + 1
            done = flat | (change <= tol)
            fine = np.where(kept.sum(axis=1) < q, "dropped terms", "ok")
            status = np.where(done, fine, np.where(steps >= max_steps, "not converged", ""))
            # The next median lies near this one: by how much residuals moved at most, in units of their size.
            near = np.clip(4 * change, 1e-3, 0.5)
            new = {
                "b": new_b, "lo": one["median"] * (1 - near), "hi": one["median"] * (1 + near), "steps": steps.astype(np.int32), "status": _texts(status),
            }
            yield _rebuilt(batch, shape, _HUBER, new)

    def packed_step(state: pa.RecordBatch, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        size = np.abs(y - np.einsum("ni,ni->n", np.repeat(_numbers(state, "b", w), n, axis=0), z))
        median = _middles(size, n)
        bound = np.repeat(median / MAD_TO_SD, n) * k
        weights = np.where(size <= bound, 1.0, bound / np.where(size > 0, size, 1.0))
        found = {"median": pa.array(median), "g": _lists(_sums(z * (weights * y)[:, None], n)), "h": _lists(_sums(_products(z, weights), n))}
        state = _rebuilt(state, shape, _HUBER, {"scale": median / MAD_TO_SD})
        return next(update(iter([_with_columns(state, found)])))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "we2", "core")}
            n, b, kept, centre = one["n"], _numbers(batch, "b", w), _numbers(batch, "kept", q) > 0, _numbers(batch, "centre", q)
            full = stacked.symmetric(_numbers(batch, "products", len(_pairs(w))), w)
            inverse, _ = stacked.inverses(full[:, :q, :q])
            params = kept.sum(axis=1) + 1
            with np.errstate(invalid="ignore", divide="ignore"):
                share = one["core"] / n
                kappa = 1 + params * share * (1 - share) * n / (n - 1) / (n * share**2)
                sigma = np.where((n > params) & (share > 0), np.sqrt(one["we2"] / (n - params)) * kappa / share, np.nan)
            estimates, variances = stacked.from_centre(centre, b[:, 0], b[:, 1:], _bread(n, inverse) * (sigma**2)[:, None, None])
            status = np.array(batch.column("status").to_pylist(), object)
            ses = np.sqrt(np.maximum(variances, 0))
            yield _tidy(batch, shape, status, n, _hidden(estimates, kept, n), _hidden(ses, kept, n), np.full(len(n), inf), level)

    def packed_finish(state: pa.RecordBatch, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        e = np.abs(y - np.einsum("ni,ni->n", np.repeat(_numbers(state, "b", w), n, axis=0), z))
        bound = np.repeat(state.column("scale").to_numpy(zero_copy_only=False) * k, n)
        inside = e <= bound
        found = {"we2": pa.array(_sums(np.where(inside, e * e, bound * bound), n)), "core": pa.array(_sums(inside.astype(float), n))}
        return finish(iter([_with_columns(state, found)]))

    def packed_fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed_fits(batches, shape, PIECE, max_steps, start, packed_step, packed_finish)

    packed, large = _by_size(model)
    fits = packed.mapInArrow(packed_fits, _tidy_schema(model))
    if large:
        table = _moments(large.rows, slices, q)
        found = _written(_looped(table.mapInArrow(start, _state_schema(model, _HUBER)), step, 8 * max_steps))
        ends = residuals(found, ["scale"])
        size = f"abs(e) <= scale * {k}"
        squares = [f"sum(CASE WHEN {size} THEN e * e ELSE scale * {k} * scale * {k} END) AS we2", f"count_if({size}) AS core"]
        ends = ends.groupBy(*slices).agg(*[F.expr(s) for s in squares])
        fits = fits.unionByName(_with_slice_values(found, ends, slices).mapInArrow(finish, _tidy_schema(model)))
    return model.named(fits)


def models(df: DataFrame, spec: Spec, slices: Sequence[str], level: float = 0.95) -> DataFrame:
    """Least-squares models as rows for ``predict``: slices, status, nobs, beta, cov (row by row) and the critical value.

    Dropped terms have zeros, as they add nothing to a prediction; without freedom cov and critical are null.  Terms are numbers or factors, since a
    polynomial's constants belong to the rows it was fitted on.
    """
    if spec.polys():
        raise ValueError("predictions from tables take no polynomials")
    model = _model(df, spec, slices)
    k, shape = model.k, model.shape
    table = _with_slice_values(model.every, _moments(model.rows, model.slices, k), model.slices)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, means, b, inverse, kept, rss, freedom, status = _linear(batch, k)
            with np.errstate(invalid="ignore", divide="ignore"):
                sigma2 = np.where(freedom > 0, rss / freedom, np.nan)
            lift = np.tile(np.eye(k + 1), (len(n), 1, 1))
            lift[:, 0, 1:] = -np.where(kept, means[:, :k], 0.0)
            cov = lift @ _bread(n, inverse) @ lift.transpose(0, 2, 1) * sigma2[:, None, None]
            first = means[:, k] - np.einsum("ni,ni->n", np.where(kept, means[:, :k], 0.0), b)
            beta = np.concatenate([first[:, None], b], axis=1)
            crit = np.where(freedom > 0, stacked.criticals(level, np.maximum(freedom, 1)), np.nan)
            columns = [batch.column(s) for s in shape.slices]
            columns += [pa.array(status, pa.string()), pa.array(n.astype(np.int64)), _lists(beta), _lists(cov.reshape(len(n), -1)), pa.array(crit)]
            yield pa.RecordBatch.from_arrays(columns, [*shape.slices, "status", "nobs", "beta", "cov", "critical"])

    kinds = {"status": "string", "nobs": "long", "beta": "array<double>", "cov": "array<double>", "critical": "double"}
    return model.named(table.mapInArrow(solve, _state_schema(model, kinds)))


def predict(fitted: DataFrame, rows: DataFrame, spec: Spec, slices: Sequence[str]) -> DataFrame:
    """``rows`` (slices and the columns of the terms) with predicted, std_error, conf_low and conf_high of their slice's model.

    Models join their rows by slice; the quadratic form is an expression over the joined arrays, so no model reaches the driver.  A row without a
    model, or with a null in a term, has nulls.
    """
    data, _ = _numeric(rows.withColumn(spec.outcome, F.lit(None).cast("double")), spec) if spec.outcome not in rows.columns else _numeric(rows, spec)

    def cols_of(part) -> list[Column]:
        return part_columns(part, F.col, lambda p: [])

    x = [F.lit(1.0), *[c for t in spec.terms for c in term_columns(t, cols_of)]]
    w = len(x)
    names = [f"__x{i}" for i in range(w)]
    side = fitted.select(*slices, *[F.col(c).alias(f"__{c}") for c in ("beta", "cov", "critical")])
    joined = _with_slice_values(data.withColumns(dict(zip(names, x))), side, slices)
    predicted = " + ".join(f"__beta[{i}] * __x{i}" for i in range(w))
    form = " + ".join(f"__x{i} * __x{j} * __cov[{i * w + j}]" for i in range(w) for j in range(w))
    numbers = ("predicted", "std_error", "conf_low", "conf_high")
    found = joined.selectExpr("*", f"nanvl({predicted}, NULL) AS __p", f"nanvl({form}, NULL) AS __f", "nanvl(__critical, NULL) AS __c")
    found = found.selectExpr("*", "CASE WHEN __f IS NOT NULL THEN sqrt(greatest(__f, 0D)) END AS __s")
    found = found.selectExpr("*", "__p AS predicted", "__s AS std_error", "__p - __c * __s AS conf_low", "__p + __c * __s AS conf_high")
    return found.select(*rows.columns, *numbers)
