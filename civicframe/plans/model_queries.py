"""Queries over regressions, predictions, tables and natural breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import classify, many, predict, regress, report
from ..models.design import Poly, Spec, crossing, with_poly
from ..operators import joins
from ..sources.local import small_frame
from .registry import Tables, query, rounded

Z95 = "1.959963984540054"


def _t_quantile(z: str, dof: str) -> str:
    """SQL for a Student quantile near the normal one (Cornish-Fisher, three terms)."""
    return (
        f"({z} + (power({z}, 3) + {z}) / (4.0 * ({dof}))"
        f" + (5 * power({z}, 5) + 16 * power({z}, 3) + 3 * {z}) / (96.0 * power({dof}, 2)))"
    )


def _coef_columns(estimate: str, se: str, crit: str, digits: int = 3) -> str:
    return (
        f"round({estimate}, {digits}) AS estimate, round({se}, {digits}) AS std_error, "
        f"round({estimate} - {crit} * {se}, {digits}) AS conf_low, round({estimate} + {crit} * {se}, {digits}) AS conf_high"
    )


def _rounded_coefs(df: DataFrame, digits: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    numbers = ("estimate", "std_error", "conf_low", "conf_high")
    return df.select(*keep, "term", *[rounded(c, digits).alias(c) for c in numbers])


def _poly_sql(by: str = "", table: str = "lineitem", x: str = "l_quantity", y: str = "l_extendedprice") -> str:
    """CTE ``p``: rows with y, x and the two polynomial columns, per slice ``by``."""
    key, using = (f"{by}, ", f"JOIN {{}} USING ({by})") if by else ("", "CROSS JOIN {}")
    group = f"GROUP BY {by}" if by else ""
    return f"""
    WITH m AS (SELECT {key}count(*) AS n, avg({x}) AS mu FROM {table} {group}),
    c AS (SELECT {key}n, {x} AS x, {y} AS y, {x} - mu AS c FROM {table} {using.format('m')}),
    s AS (SELECT {key}sum(c * c) AS s2, sum(c * c * c) / sum(c * c) AS a FROM c {group}),
    u AS (SELECT {key}n, x, y, c / sqrt(s2) AS p1, (c - a) * c - s2 / n AS z2 FROM c {using.format('s')}),
    v AS (SELECT {key}sqrt(sum(z2 * z2)) AS len2 FROM u {group}),
    p AS (SELECT {key}n, x, y, p1, z2 / len2 AS p2 FROM u {using.format('v')}),
    b AS (SELECT {key}avg(y) AS b0, sum(p1 * y) AS b1, sum(p2 * y) AS b2 FROM p {group}),
    e AS (SELECT *, y - b0 - b1 * p1 - b2 * p2 AS e FROM p {using.format('b')})
    """


@query(
    "poly_basis",
    _poly_sql() + "SELECT x, round(p1, 10) AS p1, round(p2, 10) AS p2, count(*) AS n FROM p GROUP BY ALL",
)
def poly_basis(t: Tables) -> DataFrame:
    basis = with_poly(t.lineitem.select(F.col("l_quantity").alias("x")), "x", ["p1", "p2"])
    # The basis is a function of x, so one row per value shows all of it.
    return basis.groupBy("x").agg(
        rounded(F.first("p1"), 10).alias("p1"), rounded(F.first("p2"), 10).alias("p2"), F.count(F.lit(1)).alias("n")
    )


QUADRATIC = Spec.of("l_extendedprice", Poly("l_quantity", 2))
_TERMS = ["(Intercept)", "poly(l_quantity, 2)1", "poly(l_quantity, 2)2"]


def _three_terms(se: list[str], fits: str) -> str:
    crit = _t_quantile(Z95, "n - 3")
    return fits + " UNION ALL ".join(
        f"SELECT '{name}' AS term, {_coef_columns(f'b{i}', se[i], crit)} FROM f" for i, name in enumerate(_TERMS)
    )


@query(
    "ols_poly",
    _three_terms(
        ["sqrt(s2 / n)", "sqrt(s2)", "sqrt(s2)"],
        _poly_sql() + ", f AS (SELECT n, b0, b1, b2, sum(e * e) / (n - 3) AS s2 FROM e GROUP BY n, b0, b1, b2) ",
    ),
)
def ols_poly(t: Tables) -> DataFrame:
    return _rounded_coefs(report.coefficients(regress.ols(t.lineitem, QUADRATIC)))


@query(
    "ols_hc1",
    _three_terms(
        ["sqrt(k * m0) / n", "sqrt(k * m1)", "sqrt(k * m2)"],
        _poly_sql()
        + """, f AS (SELECT n, b0, b1, b2, n / (n - 3) AS k, sum(e * e) AS m0, sum(e * e * p1 * p1) AS m1,
                            sum(e * e * p2 * p2) AS m2 FROM e GROUP BY ALL) """,
    ),
)
def ols_hc1(t: Tables) -> DataFrame:
    return _rounded_coefs(report.coefficients(regress.ols(t.lineitem, QUADRATIC, vcov="HC1")))


def _line_sql(x: str = "l_quantity", y: str = "l_extendedprice", by: str = "l_returnflag") -> str:
    return f"""
    WITH g AS (SELECT {by}, count(*) AS n, avg({x}) AS mx, regr_intercept({y}, {x}) AS b0, regr_slope({y}, {x}) AS b1,
                      regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy
               FROM lineitem GROUP BY {by}),
    f AS (SELECT *, (syy - sxy * sxy / sxx) AS rss, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM g)
    """


STRAIGHT = Spec.of("l_extendedprice", "l_quantity")


@query(
    "ols_by_slice",
    _line_sql()
    + f"""
    SELECT l_returnflag, '(Intercept)' AS term, {_coef_columns('b0', 'sqrt(s2 * (1.0 / n + mx * mx / sxx))', _t_quantile(Z95, 'n - 2'))} FROM f
    UNION ALL
    SELECT l_returnflag, 'l_quantity', {_coef_columns('b1', 'sqrt(s2 / sxx)', _t_quantile(Z95, 'n - 2'))} FROM f
    """,
)
def ols_by_slice(t: Tables) -> DataFrame:
    fit = regress.ols(t.lineitem, STRAIGHT, slices=["l_returnflag"])
    return _rounded_coefs(report.coefficients(fit), keep=("l_returnflag",))


@query(
    "fit_stats",
    _line_sql()
    + """
    SELECT l_returnflag, n AS nobs, round(1 - rss / syy, 8) AS r2, round(1 - (rss / (n - 2)) / (syy / (n - 1)), 8) AS adj_r2,
           round(sqrt(rss / n), 4) AS rmse FROM f
    """,
)
def fit_stats(t: Tables) -> DataFrame:
    fit = regress.ols(t.lineitem, STRAIGHT, slices=["l_returnflag"])
    stats = report.fit_stats(fit, omit="AIC|BIC|Log")
    return stats.select(
        "l_returnflag", "nobs", rounded("r2", 8).alias("r2"), rounded("adj_r2", 8).alias("adj_r2"),
        rounded("rmse", 4).alias("rmse"),
    )


_TWO_LINES = """
    WITH g AS (SELECT l_linestatus = 'F' AS late, count(*) AS n, avg(l_quantity) AS mx, regr_intercept(l_extendedprice, l_quantity) AS b0,
                      regr_slope(l_extendedprice, l_quantity) AS b1, regr_sxx(l_extendedprice, l_quantity) AS sxx,
                      regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity) AS rss
               FROM lineitem GROUP BY 1),
    h AS (SELECT sum(rss) / (sum(n) - 4) AS s2, sum(n) - 4 AS dof FROM g),
    f AS (SELECT a.b0 AS a0, a.b1 AS a1, l.b0 - a.b0 AS d0, l.b1 - a.b1 AS d1, dof,
                 s2 * (1.0 / a.n + a.mx ** 2 / a.sxx) AS va0, s2 / a.sxx AS va1,
                 s2 * (1.0 / a.n + a.mx ** 2 / a.sxx + 1.0 / l.n + l.mx ** 2 / l.sxx) AS vd0, s2 / a.sxx + s2 / l.sxx AS vd1
          FROM g a, g l, h WHERE NOT a.late AND l.late)
"""
LINES = Spec.of("l_extendedprice", crossing("l_quantity", "late"))


def _late(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("late", F.col("l_linestatus") == "F")


@query(
    "ols_interaction",
    _TWO_LINES
    + " UNION ALL ".join(
        f"SELECT '{name}' AS term, {_coef_columns(b, f'sqrt({v})', _t_quantile(Z95, 'dof'))} FROM f"
        for name, b, v in [
            ("(Intercept)", "a0", "va0"), ("l_quantity", "a1", "va1"),
            ("lateTRUE", "d0", "vd0"), ("l_quantity:lateTRUE", "d1", "vd1"),
        ]
    ),
)
def ols_interaction(t: Tables) -> DataFrame:
    return _rounded_coefs(report.coefficients(regress.ols(_late(t), LINES)))


_FIXED = """
    WITH g AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_sxx(l_extendedprice, l_quantity) AS sxx,
                      regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_syy(l_extendedprice, l_quantity) AS syy
               FROM lineitem GROUP BY l_suppkey),
    h AS (SELECT sum(sxy) / sum(sxx) AS b, sum(sxx) AS sxx, sum(n) AS n, sum(n * mx) / sum(n) AS mx, sum(n * my) / sum(n) AS my,
                 (sum(syy) - sum(sxy) ** 2 / sum(sxx)) / (sum(n) - count(*) - 1) AS s2, sum(n) - count(*) - 1 AS dof FROM g)
"""


@query(
    "ols_fixed_effects",
    _FIXED
    + """
    SELECT l_suppkey, g.n, round(g.my - g.mx * b, 3) AS intercept, round(b, 4) AS slope, round(sqrt(s2 / h.sxx), 4) AS std_error
    FROM g, h
    """,
)
def ols_fixed_effects(t: Tables) -> DataFrame:
    result = regress.ols_fixed(t.lineitem, STRAIGHT, "l_suppkey")
    model = result.fit.models[()]
    slope, se = float(model.beta[1]), float(model.cov[1, 1]) ** 0.5
    return result.groups.select(
        "l_suppkey", "n", rounded("intercept", 3).alias("intercept"),
        rounded(F.lit(slope), 4).alias("slope"), rounded(F.lit(se), 4).alias("std_error"),
    )


@query(
    "predict_fixed",
    _FIXED
    + f"""
    SELECT x, round(my + b * (x - mx), 3) AS predicted,
           round(my + b * (x - mx) - {_t_quantile(Z95, 'dof')} * sqrt(s2 / n + s2 * (x - mx) ** 2 / sxx), 3) AS conf_low,
           round(my + b * (x - mx) + {_t_quantile(Z95, 'dof')} * sqrt(s2 / n + s2 * (x - mx) ** 2 / sxx), 3) AS conf_high
    FROM (SELECT DISTINCT l_quantity AS x FROM lineitem), h
    """,
)
def predict_fixed(t: Tables) -> DataFrame:
    fit = regress.ols_fixed(t.lineitem, STRAIGHT, "l_suppkey").fit
    out = predict.predict(fit, predict.observed_grid(t.lineitem, "l_quantity"))
    return _rounded_prediction(out, F.col("l_quantity").alias("x"))


@query(
    "logit_binary",
    f"""
    WITH g AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F' AND l_quantity <= 25) AS a, count(*) FILTER (l_linestatus <> 'F' AND l_quantity <= 25) AS b,
                      count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25) AS c, count(*) FILTER (l_linestatus <> 'F' AND l_quantity > 25) AS d
               FROM lineitem GROUP BY l_returnflag),
    f AS (SELECT l_returnflag, '(Intercept)' AS term, ln(a / b) AS e, sqrt(1 / a + 1 / b) AS se FROM g
          UNION ALL SELECT l_returnflag, 'bigTRUE', ln((c / d) / (a / b)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM g)
    SELECT l_returnflag, term, round(exp(e), 6) AS estimate, round(se, 6) AS std_error,
           round(exp(e - {Z95} * se), 6) AS conf_low, round(exp(e + {Z95} * se), 6) AS conf_high FROM f
    """,
)
def logit_binary(t: Tables) -> DataFrame:
    data = _late(t).withColumn("big", F.col("l_quantity") > 25)
    fit = regress.logit(data, Spec.of("late", "big"), slices=["l_returnflag"])
    return _rounded_coefs(report.coefficients(fit, exponentiate=True), 6, ("l_returnflag",))


#: SQL of the inverse of the symmetric matrix a b c / b d e / c e f.
_DET = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
_INVERSE = ", ".join(
    f"({cell}) / {_DET} AS i{at}"
    for at, cell in {
        "11": "d * f - e * e", "12": "c * e - b * f", "13": "b * e - c * d", "22": "a * f - c * c", "23": "b * c - a * e", "33": "a * d - b * b",
    }.items()
)
_NAMES = ["(Intercept)", "l_quantity", "l_discount"]


def _sums_sql(weight: str, right: str) -> str:
    """Weighted cross products of (1, u, v), and their products with ``right``."""
    pairs = {"a": "1", "b": "u", "c": "v", "d": "u * u", "e": "u * v", "f": "v * v"}
    sums = [f"sum({weight} * {x}) AS {n}" for n, x in pairs.items()]
    return ", ".join(sums + [f"sum({right} * {x}) AS g{i}" for i, x in enumerate(("1", "u", "v"), 1)])


def _solve_sql(start: bool) -> str:
    rows = (("11", "12", "13"), ("12", "22", "23"), ("13", "23", "33"))
    return ", ".join(
        (f"b{i} + " if start else "") + " + ".join(f"i{at} * g{j}" for j, at in enumerate(row, 1)) + f" AS b{i}" for i, row in enumerate(rows, 1)
    )


def _steps_sql(data: str, first: str, step, n: int) -> str:
    """CTEs b0, b1, ..: each step's estimates from the last one's."""
    return f"WITH dat AS ({data}), b0 AS ({first})" + "".join(f", {step(i)}" for i in range(1, n + 1))


def _newton(i: int) -> str:
    return f"""s{i} AS MATERIALIZED (SELECT any_value(b1) AS b1, any_value(b2) AS b2, any_value(b3) AS b3, {_sums_sql("w", "r")} FROM (
        SELECT *, p * (1 - p) AS w, y - p AS r FROM (SELECT *, 1 / (1 + exp(-(b1 + b2 * u + b3 * v))) AS p FROM dat, b{i - 1}))),
    b{i} AS MATERIALIZED (SELECT *, {_solve_sql(True)} FROM (SELECT b1 AS o1, b2 AS o2, b3 AS o3, * EXCLUDE (b1, b2, b3), b1, b2, b3, {_INVERSE} FROM s{i}))"""


def _newton_sql(steps: int = 9) -> str:
    def estimates(i: int) -> str:
        # The new b columns follow the old ones of the same name, so the step names them apart.
        return _newton(i).replace("SELECT *, b1 +", "SELECT i11, i22, i33, b1 +", 1)

    sql = _steps_sql(
        "SELECT CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END AS y, l_quantity AS u, l_discount AS v FROM lineitem",
        "SELECT 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3", estimates, steps,
    )
    rows = [
        f"SELECT '{name}' AS term, round(exp(b{k}), 6) AS estimate, round(sqrt(i{k}{k}), 6) AS std_error, "
        f"round(exp(b{k} - {Z95} * sqrt(i{k}{k})), 6) AS conf_low, round(exp(b{k} + {Z95} * sqrt(i{k}{k})), 6) AS conf_high FROM b{steps}"
        for k, name in enumerate(_NAMES, 1)
    ]
    return sql + " " + " UNION ALL ".join(rows)


@query("logit_multi", _newton_sql())
def logit_multi(t: Tables) -> DataFrame:
    fit = regress.logit(_late(t), Spec.of("late", "l_quantity", "l_discount"))
    return _rounded_coefs(report.coefficients(fit, exponentiate=True), 6)


def _reweight(i: int) -> str:
    return f"""r{i} AS MATERIALIZED (SELECT *, y - (b1 + b2 * u + b3 * v) AS x FROM dat, b{i - 1}),
    m{i} AS MATERIALIZED (SELECT median(abs(x)) / {regress.MAD_TO_SD} AS s FROM r{i}),
    t{i} AS MATERIALIZED (SELECT {_sums_sql("w", "w * y")} FROM (
        SELECT *, CASE WHEN abs(x) <= {regress.HUBER_K} * s THEN 1 ELSE {regress.HUBER_K} * s / abs(x) END AS w FROM r{i}, m{i})),
    b{i} AS MATERIALIZED (SELECT {_solve_sql(False)} FROM (SELECT *, {_INVERSE} FROM t{i}))"""


def _huber_ctes(steps: int = 30) -> str:
    """CTEs b0 (least squares), b<steps>, base (inverse cross products), sigma and plain (residual scales)."""
    first = f"SELECT {_solve_sql(False)} FROM (SELECT *, {_INVERSE} FROM (SELECT {_sums_sql('1', 'y')} FROM dat))"
    sql = _steps_sql("SELECT l_extendedprice AS y, l_quantity AS u, l_discount AS v FROM lineitem", first, _reweight, steps)
    sql += f""", base AS (SELECT a AS n, {_INVERSE} FROM (SELECT {_sums_sql('1', 'y')} FROM dat)),
    ends AS (SELECT count(*) AS n, count(*) FILTER (abs(x) <= {regress.HUBER_K} * s) / count(*) AS share,
                    sum(CASE WHEN abs(x) <= {regress.HUBER_K} * s THEN x * x ELSE power({regress.HUBER_K} * s, 2) END) AS we2
             FROM (SELECT y - (b1 + b2 * u + b3 * v) AS x FROM dat, b{steps}), m{steps}),
    sigma AS (SELECT sqrt(we2 / (n - 3)) * (1 + 3 * (share * (1 - share) * n / (n - 1)) / (n * share * share)) / share AS s FROM ends),
    plain AS (SELECT sqrt(sum(power(y - (b1 + b2 * u + b3 * v), 2)) / (count(*) - 3)) AS s FROM dat, b0)"""
    return sql


def _huber_sql(steps: int = 30) -> str:
    sql, rows = _huber_ctes(steps), []
    for name, b, s, crit in (("huber", f"b{steps}", "sigma", Z95), ("ols", "b0", "plain", _t_quantile(Z95, "n - 3"))):
        rows += [
            f"SELECT '{name}' AS estimator, '{term}' AS term, {_coef_columns(f'b{k}', f's * sqrt(i{k}{k})', crit, 1)} FROM {b}, {s}, base"
            for k, term in enumerate(_NAMES, 1)
        ]
    return sql + " " + " UNION ALL ".join(rows)


ROBUST = Spec.of("l_extendedprice", "l_quantity", "l_discount")


@query("huber_m", _huber_sql())
def huber_m(t: Tables) -> DataFrame:
    robust = report.coefficients(regress.fit(t.lineitem, ROBUST, "huber", tol=1e-8))
    plain = report.coefficients(regress.fit(t.lineitem, ROBUST, "ols"))
    pairs = [predict.labelled(robust, estimator="huber"), predict.labelled(plain, estimator="ols")]
    return _rounded_coefs(joins.stack(*pairs), 1, keep=("estimator",))


@query(
    "huber_grid",
    _huber_ctes()
    + f"""
    , grid AS (SELECT range::DOUBLE AS l_quantity, (SELECT avg(v) FROM dat) AS v FROM range(1, 51)),
    d AS (SELECT l_quantity, b1 + b2 * l_quantity + b3 * v AS p, s * sqrt(i11 + 2 * i12 * l_quantity + 2 * i13 * v + i22 * l_quantity * l_quantity
            + 2 * i23 * l_quantity * v + i33 * v * v) AS se FROM grid, b30, sigma, base)
    SELECT l_quantity, round(p, 1) AS predicted, round(p - {Z95} * se, 1) AS conf_low, round(p + {Z95} * se, 1) AS conf_high FROM d
    """,
)
def huber_grid(t: Tables) -> DataFrame:
    """Predictions of the robust fit along one covariate, the other at its mean."""
    fit = regress.fit(t.lineitem, ROBUST, "huber", tol=1e-8)
    found = predict.predict(fit, predict.value_grid(t.lineitem, "l_quantity", 1, 50))
    return found.select("l_quantity", *[rounded(c, 1).alias(c) for c in ("predicted", "conf_low", "conf_high")])


def _sandwich(k: int) -> str:
    """Variance of estimate k: row k of the inverse on both sides of the sums of squared residuals."""
    at = lambda i, j: f"{min(i, j)}{max(i, j)}"
    return " + ".join(f"i{at(k, i)} * m{at(i, j)} * i{at(k, j)}" for i in (1, 2, 3) for j in (1, 2, 3))


_MEAT = ", ".join(f"sum(x * x * {a} * {b}) AS m{i}{j}" for i, a in enumerate(("1", "u", "v"), 1) for j, b in enumerate(("1", "u", "v"), 1) if i <= j)


@query(
    "ols_hc1_covariates",
    "WITH dat AS (SELECT l_extendedprice AS y, l_quantity AS u, l_discount AS v FROM lineitem), "
    + f"base AS (SELECT *, {_solve_sql(False)} FROM (SELECT *, {_INVERSE} FROM (SELECT count(*) AS n, {_sums_sql('1', 'y')} FROM dat))), "
    + f"meat AS (SELECT {_MEAT} FROM (SELECT *, y - (b1 + b2 * u + b3 * v) AS x FROM dat, base)) "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS term, {_coef_columns(f'b{k}', f'sqrt(n / (n - 3) * ({_sandwich(k)}))', _t_quantile(Z95, 'n - 3'))} FROM base, meat"
        for k, name in enumerate(_NAMES, 1)
    ),
)
def ols_hc1_covariates(t: Tables) -> DataFrame:
    return _rounded_coefs(report.coefficients(regress.ols(t.lineitem, ROBUST, vcov="HC1")))


@query(
    "ols_poly_fixed_effects",
    f"""
    WITH m AS (SELECT avg(l_quantity) AS mu, count(*) AS n FROM lineitem),
    c AS (SELECT l_suppkey AS g, l_extendedprice AS y, l_quantity - mu AS c, n FROM lineitem, m),
    s AS (SELECT sum(c * c) AS s2, sum(c * c * c) / sum(c * c) AS a FROM c),
    u AS (SELECT g, y, c / sqrt(s2) AS p1, (c - a) * c - s2 / n AS z2 FROM c, s),
    l AS (SELECT sqrt(sum(z2 * z2)) AS len2 FROM u),
    w AS (SELECT y - avg(y) OVER (PARTITION BY g) AS y, p1 - avg(p1) OVER (PARTITION BY g) AS u, z2 / len2 - avg(z2 / len2) OVER (PARTITION BY g) AS v FROM u, l),
    k AS (SELECT count(*) AS n, sum(u * u) AS a, sum(u * v) AS b, sum(v * v) AS d, sum(u * y) AS g1, sum(v * y) AS g2, sum(y * y) AS yy FROM w),
    f AS (SELECT *, a * d - b * b AS det, (d * g1 - b * g2) / (a * d - b * b) AS b1, (a * g2 - b * g1) / (a * d - b * b) AS b2,
                 n - 2 - (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS dof FROM k),
    z AS (SELECT *, (yy - b1 * g1 - b2 * g2) / dof AS s2 FROM f)
    SELECT 'poly(l_quantity, 2)1' AS term, {_coef_columns('b1', 'sqrt(s2 * d / det)', _t_quantile(Z95, 'dof'))} FROM z
    UNION ALL SELECT 'poly(l_quantity, 2)2', {_coef_columns('b2', 'sqrt(s2 * a / det)', _t_quantile(Z95, 'dof'))} FROM z
    """,
)
def ols_poly_fixed_effects(t: Tables) -> DataFrame:
    fixed = regress.ols_fixed(t.lineitem, QUADRATIC, "l_suppkey")
    return _rounded_coefs(report.coefficients(fixed.fit).filter("term <> '(Intercept)'"))


@query(
    "ols_many_slices",
    """
    WITH l AS (SELECT l_orderkey, l_quantity AS x, CASE WHEN l_orderkey % 7 <> 0 THEN ln(l_extendedprice) END AS y FROM lineitem),
    g AS (SELECT l_orderkey, count(y) AS n, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM l GROUP BY 1)
    SELECT l_orderkey, n AS nobs, CASE WHEN n = 0 THEN 'no complete rows' WHEN n = 1 OR sxx = 0 THEN 'dropped terms' WHEN n = 2 THEN 'no freedom' ELSE 'ok' END AS status,
           round(CASE WHEN n = 1 OR sxx = 0 THEN m ELSE a END, 8) AS intercept, round(CASE WHEN n > 1 AND sxx > 0 THEN b END, 8) AS slope
    FROM g
    """,
)
def ols_many_slices(t: Tables) -> DataFrame:
    """A model for every order; many orders are too small, constant or without any outcome."""
    known = F.when(F.col("l_orderkey") % 7 != 0, F.ln("l_extendedprice"))
    rows = t.lineitem.select("l_orderkey", "l_quantity", known.alias("price"))
    terms = many.ols(rows, Spec.of("price", "l_quantity"), ["l_orderkey"])
    first, second = (F.max(F.when(F.col("term") == n, F.col("estimate"))) for n in ("(Intercept)", "l_quantity"))
    return terms.groupBy("l_orderkey", "nobs", "status").agg(rounded(first, 8).alias("intercept"), rounded(second, 8).alias("slope"))


_PER_ORDER = "l AS (SELECT l_orderkey, l_quantity AS x, CASE WHEN l_orderkey % 7 <> 0 THEN ln(l_extendedprice) END AS y, l_linestatus AS h FROM lineitem)"


def _order_rows(t: Tables) -> DataFrame:
    known = F.when(F.col("l_orderkey") % 7 != 0, F.ln("l_extendedprice"))
    return t.lineitem.select("l_orderkey", "l_quantity", "l_linestatus", known.alias("price"))


def _wide(terms: DataFrame, digits: int, errors: bool = True) -> DataFrame:
    """A row per order: status, and the estimates of both terms."""
    pick = {"intercept": ("(Intercept)", "estimate"), "slope": ("l_quantity", "estimate")}
    if errors:
        pick |= {"intercept_se": ("(Intercept)", "std_error"), "slope_se": ("l_quantity", "std_error")}
    picked = [rounded(F.max(F.when(F.col("term") == name, F.col(c))), digits).alias(out) for out, (name, c) in pick.items()]
    return terms.groupBy("l_orderkey", "nobs", "status").agg(*picked)


@query(
    "hc1_many_slices",
    f"""
    WITH {_PER_ORDER},
    g AS (SELECT l_orderkey, count(y) AS n, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m,
                 avg(CASE WHEN y IS NOT NULL THEN x END) AS mx FROM l GROUP BY 1),
    e AS (SELECT l_orderkey, n, sxx, b, a, m, mx, x, CASE WHEN n = 1 OR sxx = 0 THEN y - m ELSE y - a - b * x END AS e FROM l JOIN g USING (l_orderkey)),
    s AS (SELECT l_orderkey, sum(e * e * (x - mx) ** 2) AS bb, sum(e * e * (1.0 / n - CASE WHEN sxx > 0 THEN mx * (x - mx) / sxx ELSE 0 END) ** 2) AS aa FROM e GROUP BY 1)
    SELECT l_orderkey, n AS nobs, CASE WHEN n = 0 THEN 'no complete rows' WHEN n = 1 OR sxx = 0 THEN 'dropped terms' WHEN n = 2 THEN 'no freedom' ELSE 'ok' END AS status,
           round(CASE WHEN n = 1 OR sxx = 0 THEN m ELSE a END, 6) AS intercept, round(CASE WHEN n > 1 AND sxx > 0 THEN b END, 6) AS slope,
           round(CASE WHEN n > 1 AND sxx = 0 THEN sqrt(aa * n / (n - 1.0)) WHEN n > 2 THEN sqrt(aa * n / (n - 2.0)) END, 6) AS intercept_se,
           round(CASE WHEN n > 2 AND sxx > 0 THEN sqrt(bb * n / (n - 2.0)) / sxx END, 6) AS slope_se
    FROM g JOIN s USING (l_orderkey)
    """,
)
def hc1_many_slices(t: Tables) -> DataFrame:
    """Robust errors of a model for every order."""
    return _wide(many.hc1(_order_rows(t), Spec.of("price", "l_quantity"), ["l_orderkey"]), 6)


@query(
    "fixed_many_slices",
    f"""
    WITH {_PER_ORDER},
    k AS (SELECT * FROM l WHERE y IS NOT NULL),
    c AS (SELECT l_orderkey, x, y, h, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM k WINDOW w AS (PARTITION BY l_orderkey, h)),
    g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT h) AS groups, avg(x) AS mx, avg(y) AS my, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy, sum(dy * dy) AS syy FROM c GROUP BY 1),
    f AS (SELECT *, CASE WHEN sxx > 1e-9 THEN sxy / sxx END AS b, n - groups - (sxx > 1e-9)::INT AS dof FROM g),
    r AS (SELECT *, greatest(syy - coalesce(b, 0) * sxy, 0) / CASE WHEN dof > 0 THEN dof END AS s2 FROM f)
    SELECT l_orderkey, coalesce(n, 0) AS nobs,
           CASE WHEN n IS NULL THEN 'no complete rows' WHEN b IS NULL THEN 'dropped terms' WHEN dof <= 0 THEN 'no freedom' ELSE 'ok' END AS status,
           round(my - coalesce(b, 0) * mx, 6) AS intercept, round(b, 6) AS slope,
           round(sqrt(s2 * (1.0 / n + CASE WHEN b IS NULL THEN 0 ELSE mx * mx / sxx END)), 6) AS intercept_se, round(CASE WHEN b IS NOT NULL THEN sqrt(s2 / sxx) END, 6) AS slope_se
    FROM (SELECT DISTINCT l_orderkey FROM l) LEFT JOIN r USING (l_orderkey)
    """,
)
def fixed_many_slices(t: Tables) -> DataFrame:
    """A model for every order with an intercept for each line status."""
    return _wide(many.fixed(_order_rows(t), Spec.of("price", "l_quantity"), "l_linestatus", ["l_orderkey"]), 6)


@query(
    "logit_many_slices",
    """
    WITH c AS (SELECT l_orderkey, count(*) AS n, count_if(x = 1 AND y = 1) AS a, count_if(x = 1 AND y = 0) AS b, count_if(x = 0 AND y = 1) AS c, count_if(x = 0 AND y = 0) AS d
               FROM (SELECT l_orderkey, (l_discount > 0.05)::INT AS x, (l_quantity > 25)::INT AS y FROM lineitem) GROUP BY 1),
    s AS (SELECT *, CASE WHEN a + c = 0 OR b + d = 0 THEN 'the outcome is constant' WHEN a + b = 0 OR c + d = 0 THEN 'dropped terms'
                         WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 'separated' ELSE 'ok' END AS status FROM c)
    SELECT l_orderkey, n AS nobs, status,
           round(CASE status WHEN 'ok' THEN ln(c::DOUBLE / d) WHEN 'dropped terms' THEN ln((a + c)::DOUBLE / (b + d)) END, 6) AS intercept,
           round(CASE status WHEN 'ok' THEN ln(a::DOUBLE * d / (b * c)) END, 6) AS slope,
           round(CASE status WHEN 'ok' THEN sqrt(1.0 / c + 1.0 / d) WHEN 'dropped terms' THEN sqrt(1.0 / (a + c) + 1.0 / (b + d)) END, 6) AS intercept_se,
           round(CASE status WHEN 'ok' THEN sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d) END, 6) AS slope_se
    FROM s
    """,
)
def logit_many_slices(t: Tables) -> DataFrame:
    """A logistic model for every order; most orders are too small, and those separated are named as such."""
    rows = t.lineitem.select(
        "l_orderkey", (F.col("l_discount") > 0.05).cast("int").alias("l_quantity"), (F.col("l_quantity") > 25).cast("int").alias("large")
    )
    return _wide(many.logit(rows, Spec.of("large", "l_quantity"), ["l_orderkey"]), 6)


_HUBER_STEPS = 12


def _huber_many_sql(steps: int = _HUBER_STEPS) -> str:
    """Every order's steps side by side; an order that has settled keeps its numbers."""
    fit = "CASE WHEN {sxx} > 1e-9 THEN {sxy} / {sxx} ELSE 0 END"
    sql = f"""
    WITH {_PER_ORDER},
    k AS MATERIALIZED (SELECT l_orderkey, x, y FROM l WHERE y IS NOT NULL),
    m AS MATERIALIZED (SELECT l_orderkey, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM k GROUP BY 1),
    b0 AS MATERIALIZED (SELECT l_orderkey, n, mx, sxx > 1e-9 AS sloped, my AS a, {fit.format(sxx='sxx', sxy='sxy')} AS b, n <= 1 + (sxx > 1e-9)::INT AS over FROM m)"""
    for i in range(steps):
        sql += f""",
    e{i} AS MATERIALIZED (SELECT l_orderkey, x - mx AS z, y, y - a - b * (x - mx) AS e FROM k JOIN b{i} USING (l_orderkey) WHERE NOT over),
    s{i} AS MATERIALIZED (SELECT l_orderkey, median(abs(e)) / 0.6745 AS scale FROM e{i} GROUP BY 1),
    w{i} AS (SELECT l_orderkey, z, y, e, CASE WHEN abs(e) <= 1.345 * scale THEN 1 ELSE 1.345 * scale / abs(e) END AS w FROM e{i} JOIN s{i} USING (l_orderkey) WHERE scale > 0),
    t{i} AS (SELECT l_orderkey, sum(w) AS w, sum(w * z) AS wz, sum(w * z * z) AS wzz, sum(w * y) AS wy, sum(w * z * y) AS wzy, sum(e * e) AS old FROM w{i} GROUP BY 1),
    n{i} AS (SELECT l_orderkey, old, {fit.format(sxx='(wzz - wz * wz / w)', sxy='(wzy - wz * wy / w)')} AS b, wz / w AS z, wy / w AS y FROM t{i}),
    b{i + 1} AS MATERIALIZED (
      SELECT o.l_orderkey, o.n, o.mx, o.sloped, CASE WHEN n.old IS NULL THEN o.a ELSE n.y - CASE WHEN o.sloped THEN n.b * n.z ELSE 0 END END AS a,
             CASE WHEN n.old IS NULL THEN o.b WHEN o.sloped THEN n.b ELSE 0 END AS b,
             o.over OR n.old IS NULL OR sqrt((o.n * (n.y - CASE WHEN o.sloped THEN n.b * n.z ELSE 0 END - o.a) ** 2
               + CASE WHEN o.sloped THEN (n.b - o.b) ** 2 * m.sxx ELSE 0 END) / greatest(n.old, 1e-20)) <= 1e-4 AS over
      FROM b{i} o JOIN m USING (l_orderkey) LEFT JOIN n{i} n USING (l_orderkey))"""
    return sql + f"""
    SELECT l_orderkey, coalesce(n, 0) AS nobs,
           CASE WHEN n IS NULL THEN 'no complete rows' WHEN n <= 1 + sloped::INT THEN 'no freedom' WHEN NOT over THEN 'not converged' WHEN sloped THEN 'ok' ELSE 'dropped terms' END AS status,
           round(a - b * mx, 4) AS intercept, round(CASE WHEN sloped THEN b END, 4) AS slope
    FROM (SELECT DISTINCT l_orderkey FROM l) LEFT JOIN b{steps} USING (l_orderkey)"""


@query("huber_many_slices", _huber_many_sql())
def huber_many_slices(t: Tables) -> DataFrame:
    """A robust line through every order; those that still move after the last step are named as such."""
    fits = many.huber(_order_rows(t), Spec.of("price", "l_quantity"), ["l_orderkey"], max_steps=_HUBER_STEPS)
    return _wide(fits, 4, errors=False)


@query(
    "predict_many_slices",
    f"""
    WITH {_PER_ORDER},
    g AS (SELECT l_orderkey, count(y) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(y) AS m,
                 avg(CASE WHEN y IS NOT NULL THEN x END) AS mx FROM l GROUP BY 1),
    f AS (SELECT *, n > 1 AND sxx > 0 AS sloped, CASE WHEN n > 1 AND sxx > 0 THEN n - 2 ELSE n - 1 END AS dof FROM g),
    h AS (SELECT *, CASE WHEN dof > 0 THEN greatest(CASE WHEN sloped THEN syy - sxy * sxy / sxx ELSE syy END, 0) / dof END AS s2 FROM f)
    SELECT l_orderkey, q AS l_quantity, round(CASE WHEN sloped THEN m + sxy / sxx * (q - mx) ELSE m END, 6) AS predicted,
           round(sqrt(s2 * (1.0 / n + CASE WHEN sloped THEN (q - mx) ** 2 / sxx ELSE 0 END)), 6) AS std_error
    FROM h, (VALUES (10.0::DOUBLE), (25.0), (40.0)) AS grid(q)
    """,
)
def predict_many_slices(t: Tables) -> DataFrame:
    """Every order's model at three quantities."""
    spec, rows = Spec.of("price", "l_quantity"), _order_rows(t)
    grid = rows.select("l_orderkey").distinct().withColumn("l_quantity", F.explode(F.array(*[F.lit(q) for q in (10.0, 25.0, 40.0)])))
    found = many.predict(many.models(rows, spec, ["l_orderkey"]), grid, spec, ["l_orderkey"])
    return found.select("l_orderkey", "l_quantity", rounded("predicted").alias("predicted"), rounded("std_error").alias("std_error"))


LABELS = {"l_quantity": "Quantity", "(Intercept)": "Intercept"}


def _table_cell(b: str, se: str) -> str:
    crit = _t_quantile(Z95, "n - 2")
    cuts = [("3.290526731491926", "***"), ("2.5758293035489004", "**"), (Z95, "*")]
    stars = "CASE " + " ".join(f"WHEN abs({b} / ({se})) > {_t_quantile(z, 'n - 2')} THEN '{s}'" for z, s in cuts) + " ELSE '' END"
    return f"printf('%.1f', {b}) || {stars} || printf(' [%.1f, %.1f]', {b} - {crit} * {se}, {b} + {crit} * {se})"


@query(
    "coef_table",
    _line_sql()
    + f""", cells AS (
      SELECT 'Quantity' AS label, 1 AS rank, l_returnflag, {_table_cell('b1', 'sqrt(s2 / sxx)')} AS cell FROM f
      UNION ALL SELECT 'Intercept', 2, l_returnflag, {_table_cell('b0', 'sqrt(s2 * (1.0 / n + mx * mx / sxx))')} FROM f)
    SELECT label, rank, max(cell) FILTER (l_returnflag = 'A') AS "A", max(cell) FILTER (l_returnflag = 'N') AS "N",
           max(cell) FILTER (l_returnflag = 'R') AS "R" FROM cells GROUP BY label, rank
    """,
)
def coef_table(t: Tables) -> DataFrame:
    fit = regress.ols(t.lineitem, STRAIGHT, slices=["l_returnflag"])
    labelled = report.label_terms(report.coefficients(fit), LABELS)
    return report.side_by_side(labelled, "l_returnflag", ["A", "N", "R"])


def _rounded_prediction(df: DataFrame, *keep, digits: int = 3) -> DataFrame:
    return df.select(*keep, *[rounded(c, digits).alias(c) for c in ("predicted", "conf_low", "conf_high")])


_BAND = "{t} * sqrt(s2 * (1.0 / n + (x - mx) ** 2 / sxx))".format(t=_t_quantile(Z95, "dof"))


@query(
    "predict_grid",
    _TWO_LINES
    + f"""
    SELECT x / 100 AS x, CASE WHEN late THEN 'Yes' ELSE 'No' END AS grp, round((b0 + b1 * x) / 1000, 6) AS predicted,
           round((b0 + b1 * x - {_BAND}) / 1000, 6) AS conf_low, round((b0 + b1 * x + {_BAND}) / 1000, 6) AS conf_high
    FROM g, h, (SELECT unnest(range(5, 46))::DOUBLE AS x)
    """,
)
def predict_grid(t: Tables) -> DataFrame:
    fit = regress.ols(_late(t), LINES)
    grid = predict.with_levels(predict.value_grid(t.lineitem, "l_quantity", 5, 45), "late", [True, False])
    out = predict.rescale(predict.predict(fit, grid, hold=predict.AT_BASE), 1000)
    group = F.when(F.col("late"), "Yes").otherwise("No").alias("grp")
    return _rounded_prediction(out, (F.col("l_quantity") / 100).alias("x"), group, digits=6)


@query(
    "predict_all_values",
    _poly_sql("l_returnflag")
    + f""", f AS (
      SELECT l_returnflag, n, b0, b1, b2, n / (n - 3) AS k, sum(e * e) AS m00, sum(e * e * p1) AS m01, sum(e * e * p2) AS m02,
             sum(e * e * p1 * p1) AS m11, sum(e * e * p1 * p2) AS m12, sum(e * e * p2 * p2) AS m22 FROM e GROUP BY ALL),
    q AS (
      SELECT DISTINCT l_returnflag, x, b0 + b1 * p1 + b2 * p2 AS yhat, f.n,
             sqrt(k * (m00 / (f.n * f.n) + p1 * p1 * m11 + p2 * p2 * m22 + 2 * (p1 * m01 / f.n + p2 * m02 / f.n + p1 * p2 * m12))) AS se
      FROM p JOIN f USING (l_returnflag))
    SELECT l_returnflag, x, 'Covariates' AS type, round(yhat, 3) AS predicted, round(yhat - {_t_quantile(Z95, 'n - 3')} * se, 3) AS conf_low,
           round(yhat + {_t_quantile(Z95, 'n - 3')} * se, 3) AS conf_high FROM q GROUP BY ALL
    """,
)
def predict_all_values(t: Tables) -> DataFrame:
    fit = regress.ols(t.lineitem, QUADRATIC, slices=["l_returnflag"], vcov="HC1")
    grid = predict.observed_grid(t.lineitem, "l_quantity", ["l_returnflag"])
    out = predict.labelled(predict.predict(fit, grid), type="Covariates")
    return _rounded_prediction(out, "l_returnflag", F.col("l_quantity").alias("x"), "type")


CLASSES = 4

_JENKS = """
    WITH counts AS (SELECT c_nationkey, count(*) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
    d AS (SELECT x, count(*) AS w FROM counts GROUP BY x),
    s AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS n, sum(w * x) OVER (ORDER BY x) AS s,
                 sum(w * x * x) OVER (ORDER BY x) AS q FROM d),
    z AS (SELECT max(i) AS m, max(x) AS top, min(x) AS low FROM s),
    e AS (SELECT * FROM s, z WHERE i = m),
    best AS (
      SELECT a.x AS b1, b.x AS b2, c.x AS b3, e.low, e.top,
             a.q - a.s ** 2 / a.n + (b.q - a.q) - (b.s - a.s) ** 2 / (b.n - a.n)
             + (c.q - b.q) - (c.s - b.s) ** 2 / (c.n - b.n) + (e.q - c.q) - (e.s - c.s) ** 2 / (e.n - c.n) AS cost
      FROM s a, s b, s c, e WHERE a.i < b.i AND b.i < c.i AND c.i < e.i ORDER BY round(cost, 6), b1, b2, b3 LIMIT 1)
"""


def _orders_per_nation(t: Tables) -> DataFrame:
    by_customer = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("x"))
    nation = t.customer.select("c_custkey", "c_nationkey")
    joined = joins.left_join(by_customer, nation, [("o_custkey", "c_custkey")], null_safe=False)
    return joined.groupBy("c_nationkey").agg(F.sum("x").alias("x"))


@query(
    "jenks_breaks",
    _JENKS
    + " UNION ALL ".join(
        f"SELECT {i} AS position, CAST({c} AS DOUBLE) AS break FROM best" for i, c in enumerate(["low", "b1", "b2", "b3", "top"])
    ),
)
def jenks_breaks(t: Tables) -> DataFrame:
    breaks = classify.jenks_breaks(_orders_per_nation(t), "x", CLASSES)
    return small_frame(t.spark, list(enumerate(breaks)), "position int, break double")


@query(
    "jenks_breaks_many",
    """
    WITH v AS (SELECT l_extendedprice::DOUBLE AS x, count(*) AS c FROM lineitem GROUP BY 1),
    m AS (SELECT avg(l_extendedprice) AS mu, min(l_extendedprice)::DOUBLE AS low, max(l_extendedprice)::DOUBLE AS top FROM lineitem),
    r AS (SELECT x, sum(c) OVER w AS n, sum(c * (x - mu)) OVER w AS s, sum(c) OVER () AS all_n, sum(c * (x - mu)) OVER () AS all_s
          FROM v, m WINDOW w AS (ORDER BY x)),
    k AS (SELECT x FROM r WHERE n < all_n ORDER BY s * s / n + (all_s - s) ** 2 / (all_n - n) DESC, x LIMIT 1)
    SELECT 0 AS position, low AS break FROM m UNION ALL SELECT 1, x FROM k UNION ALL SELECT 2, top FROM m
    """,
)
def jenks_breaks_many(t: Tables) -> DataFrame:
    """Two classes of nearly unique prices: every value is a possible limit, and the one found is proved to be the best."""
    breaks = classify.jenks_breaks(t.lineitem, "l_extendedprice", 2)
    return small_frame(t.spark, list(enumerate(breaks)), "position int, break double")


@query(
    "bin_labels",
    _JENKS
    + """
    SELECT c_nationkey, x, CASE WHEN x <= b1 THEN 1 WHEN x <= b2 THEN 2 WHEN x <= b3 THEN 3 ELSE 4 END AS class,
           CASE WHEN x <= b1 THEN '[' || low || ',' || b1 || ']' WHEN x <= b2 THEN '(' || b1 || ',' || b2 || ']'
                WHEN x <= b3 THEN '(' || b2 || ',' || b3 || ']' ELSE '(' || b3 || ',' || top || ']' END AS class_interval,
           CASE WHEN x <= b1 THEN low || '-' || b1 WHEN x <= b2 THEN (b1 + 1) || '-' || b2
                WHEN x <= b3 THEN (b2 + 1) || '-' || b3 ELSE (b3 + 1) || '-' || top END AS class_range
    FROM counts, best
    """,
)
def bin_labels(t: Tables) -> DataFrame:
    counts = _orders_per_nation(t)
    breaks = classify.jenks_breaks(counts, "x", CLASSES)
    return classify.with_classes(counts, "x", breaks)

