"""Model terms as Spark expressions.

A spec is an outcome and a list of terms.  Its design columns are plain column
expressions over the input row; the only fitted constants, those of orthogonal
polynomials, come from one aggregate of centred power sums per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from math import isfinite, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.local import small_frame

@dataclass(frozen=True)
class Num:
    """A numeric column, or a boolean one as 0/1."""

    column: str


@dataclass(frozen=True)
class Poly:
    """Orthogonal polynomial of degree 1 or 2, unit length over the slice."""

    column: str
    degree: int = 2


@dataclass(frozen=True)
class Factor:
    """Treatment coding: one 0/1 column per level but the first (the base)."""

    column: str
    levels: tuple[str, ...]


@dataclass(frozen=True)
class Inter:
    """Products of the columns of two terms."""

    a: Num | Poly | Factor
    b: Num | Poly | Factor


Term = Num | Poly | Factor | Inter


def term(t: str | Term) -> Term:
    return Num(t) if isinstance(t, str) else t


def crossing(a: str | Term, b: str | Term) -> list[Term]:
    """Both terms and their interaction."""
    a, b = term(a), term(b)
    return [a, b, Inter(a, b)]


@dataclass(frozen=True)
class Spec:
    """``outcome ~ terms``; repeated terms count once, interactions come last."""

    outcome: str
    terms: tuple[Term, ...]

    @staticmethod
    def of(outcome: str, *terms: str | Term | list[Term]) -> Spec:
        flat = [term(x) for t in terms for x in (t if isinstance(t, list) else [t])]
        unique = list(dict.fromkeys(flat))
        return Spec(outcome, tuple(sorted(unique, key=lambda t: isinstance(t, Inter))))

    def parts(self) -> list[Num | Poly | Factor]:
        out = [p for t in self.terms for p in ((t.a, t.b) if isinstance(t, Inter) else (t,))]
        return list(dict.fromkeys(out))

    def columns(self) -> list[str]:
        return list(dict.fromkeys(p.column for p in self.parts()))

    def polys(self) -> list[Poly]:
        return [p for p in self.parts() if isinstance(p, Poly)]


@dataclass(frozen=True)
class PolyConst:
    """mean, shift and lengths: p1 = c/len1, p2 = ((c-a)c - m2)/len2 with c = x - mean."""

    mean: float
    a: float
    m2: float
    len1: float
    len2: float

    WIDTH = 5

    def values(self) -> list[float]:
        return [self.mean, self.a, self.m2, self.len1, self.len2]


def poly_columns(x: Column, const: Sequence[Column], degree: int) -> list[Column]:
    mean, a, m2, len1, len2 = const
    c = x - mean
    out = [c / len1, ((c - a) * c - m2) / len2]
    return out[:degree]


def part_columns(part, value: Callable[[str], Column], const: Callable[[Poly], Sequence[Column]]) -> list[Column]:
    """Design columns of a term part, from a function that gives a column's value."""
    if isinstance(part, Num):
        return [value(part.column)]
    if isinstance(part, Poly):
        return poly_columns(value(part.column), const(part), part.degree)
    return [(value(part.column) == F.lit(lv)).cast("double") for lv in part.levels[1:]]


def part_names(part, booleans: set[str]) -> list[str]:
    if isinstance(part, Num):
        return [part.column + ("TRUE" if part.column in booleans else "")]
    if isinstance(part, Poly):
        return [f"poly({part.column}, {part.degree}){i + 1}" for i in range(part.degree)]
    return [f"{part.column}{lv}" for lv in part.levels[1:]]


def term_columns(t: Term, part_cols: Callable) -> list[Column]:
    if isinstance(t, Inter):
        return [a * b for b in part_cols(t.b) for a in part_cols(t.a)]
    return part_cols(t)


def term_names(t: Term, booleans: set[str]) -> list[str]:
    if isinstance(t, Inter):
        return [f"{a}:{b}" for b in part_names(t.b, booleans) for a in part_names(t.a, booleans)]
    return part_names(t, booleans)


class SliceTable:
    """Per-slice numbers as columns of a table joined to the rows by slice.

    The table has one row per slice; Spark broadcasts it while it is small.  Rows of
    slices without numbers are left out, since those cannot be fitted.  Without
    slices the numbers are literals and no join happens.
    """

    def __init__(self, df: DataFrame, slices: Sequence[str], arrays: dict[str, dict[tuple, Sequence[float]]]):
        self.slices, self.arrays = list(slices), arrays
        keys = list(next(iter(arrays.values()))) if arrays else []
        if self.slices and arrays:
            schema = T.StructType(
                [T.StructField("__s_" + s, df.schema[s].dataType) for s in self.slices]
                + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in arrays]
            )
            rows = [(*k, *[[float(v) for v in arrays[n][k]] for n in arrays]) for k in keys]
            side = small_frame(df.sparkSession, rows, schema)
            cond = None
            for s in self.slices:
                same = F.col(s).eqNullSafe(F.col("__s_" + s))
                cond = same if cond is None else cond & same
            df = df.join(side, cond).drop(*["__s_" + s for s in self.slices])
        self.df = df

    def get(self, name: str, i: int) -> Column:
        if self.slices:
            return F.get(F.col(name), F.lit(i))
        return F.lit(float(self.arrays[name][()][i]))

    def sql(self, name: str, i: int) -> str:
        """``get`` as SQL text, for sums with many terms."""
        if self.slices:
            return f"{name}[{i}]"
        value = float(self.arrays[name][()][i])
        return f"{value!r}D" if isfinite(value) else f"double('{value}')"

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.arrays) if self.slices else df


@dataclass
class Design:
    """Rows with their design columns ``__x0 ..`` and outcome ``__y``, nulls dropped."""

    spec: Spec
    slices: list[str]
    names: list[str]
    rows: DataFrame
    poly: dict[tuple, list[float]] = field(default_factory=dict)
    booleans: set[str] = field(default_factory=set)
    #: Slices that have no design, with the reason.
    problems: dict[tuple, str] = field(default_factory=dict)

    @property
    def x(self) -> list[str]:
        return [f"__x{i}" for i in range(len(self.names))]


def _numeric(df: DataFrame, spec: Spec) -> tuple[DataFrame, set[str]]:
    """Columns of the model as doubles (factor columns stay text)."""
    factors = {p.column for p in spec.parts() if isinstance(p, Factor)}
    booleans = {c for c in spec.columns() if isinstance(df.schema[c].dataType, T.BooleanType)}
    used = [spec.outcome, *[c for c in spec.columns() if c not in factors]]
    casts = {}
    for c in dict.fromkeys(used):
        col = F.col(c)
        as_int = col.cast("int") if isinstance(df.schema[c].dataType, T.BooleanType) else col
        casts[c] = as_int.cast("double")
    return df.withColumns(casts), booleans


def poly_constants(
    df: DataFrame, polys: Sequence[Poly], slices: Sequence[str]
) -> tuple[dict[tuple, list[float]], dict[tuple, str]]:
    """Constants of every polynomial by slice, from one aggregate; and the slices that have none, with the reason.

    Without slices the reason is raised.

    With c = x - mean, power sums of c give everything: s2 = sum c^2,
    a = sum c^3 / s2, and the squared length of (c-a)c - s2/n is
    sum c^4 - a * sum c^3 - s2^2 / n.  Spark's variance, skewness and kurtosis hold these
    sums about the mean and combine them task by task, so no pass for the mean comes first.  Rows with a null or NaN in *other* columns
    count; only those of the polynomial's own column are left out.
    """
    present = {p.column: F.when(~F.isnan(p.column), F.col(p.column)) for p in polys}
    cols = list(present)
    sums = []
    for i, c in enumerate(cols):
        kinds = (("n", F.count), ("m", F.avg), ("v", F.var_pop), ("g", F.skewness), ("k", F.kurtosis))
        sums += [f(present[c]).alias(f"{name}{i}") for name, f in kinds]
    out, problems = {}, {}
    found = df.groupBy(*slices).agg(*sums).collect()
    if not found:
        return {}, {}
    for r in found:
        key = tuple(r[s] for s in slices)
        flat: list[float] = []
        for p in polys:
            c, i = p.column, cols.index(p.column)
            n, mean, var = r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]
            if not n:
                problems[key] = f"no value of {c}"
                break
            s2 = n * var
            s3, s4 = (n * r[f"g{i}"] * var**1.5, n * (r[f"k{i}"] + 3) * var**2) if s2 > 0 else (0.0, 0.0)
            if not s2 > 0:
                problems[key] = f"{c} is constant"
                break
            a = s3 / s2
            length2 = s4 - a * s3 - s2 * s2 / n
            if p.degree == 2 and not length2 > 1e-12 * s4:
                problems[key] = f"{c} has too few distinct values for degree 2"
                break
            flat += PolyConst(mean, a, s2 / n, sqrt(s2), sqrt(max(length2, 0.0)) or 1.0).values()
        else:
            out[key] = flat
    if problems and not slices:
        raise ValueError(problems[()])
    return out, problems


def with_poly(df: DataFrame, column: str, names: Sequence[str], slices: Sequence[str] = ()) -> DataFrame:
    """Add the orthogonal polynomial columns of ``column``, fitted per slice."""
    poly = Poly(column, len(names))
    data = df.withColumn(column, F.col(column).cast("double"))
    constants, problems = poly_constants(data, [poly], list(slices))
    if problems:
        raise ValueError(f"no polynomial in slices {sorted(problems.items(), key=str)[:3]}")
    table = SliceTable(data, list(slices), {"__poly": constants})
    const = [table.get("__poly", j) for j in range(PolyConst.WIDTH)]
    out = table.df.withColumns(dict(zip(names, poly_columns(F.col(column), const, poly.degree))))
    return table.drop(out)


def build(df: DataFrame, spec: Spec, slices: Sequence[str] = (), extra: Sequence[str] = ()) -> Design:
    slices = list(slices)
    keep = list(dict.fromkeys([*slices, *extra, spec.outcome, *spec.columns()]))
    data, booleans = _numeric(df.select(*keep), spec)
    polys = spec.polys()
    poly, problems = poly_constants(data, polys, slices) if polys else ({}, {})
    if polys and not poly:
        raise ValueError("no slice can be fitted")
    table = SliceTable(data, slices, {"__poly": poly} if polys else {})
    at = {p: i * PolyConst.WIDTH for i, p in enumerate(polys)}

    def const(p: Poly) -> list[Column]:
        return [table.get("__poly", at[p] + j) for j in range(PolyConst.WIDTH)]

    def cols_of(part):
        return part_columns(part, F.col, const)

    exprs = [c for t in spec.terms for c in term_columns(t, cols_of)]
    names = [n for t in spec.terms for n in term_names(t, booleans)]
    complete = table.df.dropna(subset=list(dict.fromkeys([spec.outcome, *spec.columns()])))
    rows = complete.select(
        *slices, *extra, F.col(spec.outcome).alias("__y"), *[e.alias(f"__x{i}") for i, e in enumerate(exprs)],
        *[F.col(c).alias(f"__v_{c}") for c in spec.columns()],
    )
    return Design(spec, slices, names, rows, poly, booleans, problems)
