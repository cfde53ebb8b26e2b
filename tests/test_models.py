"""Regressions against independent numpy fits, and their properties."""

import itertools
import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from civicframe.models import design as D
from civicframe.models import many
from civicframe.models import predict as P
from civicframe.models import regress as R
from civicframe.models import report
from civicframe.models.dist import critical, t_two_sided
from civicframe.sources.local import small_frame


def made(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(50, 20, n), rng.normal(size=n)
    f = rng.choice(["a", "b", "c"], n)
    g = rng.choice(["u", "v"], n)
    b = rng.random(n) < 0.4
    y = 3 + 0.2 * x - 0.002 * x**2 + 1.5 * z + 2 * b + (f == "c") * 4 + rng.normal(size=n) * (1 + (x > 50))
    return x, z, f, g, b, y


SCHEMA = "x double, z double, f string, g string, b boolean, y double"


@pytest.fixture(scope="module")
def data(spark):
    cols = made()
    out = small_frame(spark, list(zip(*[c.tolist() for c in cols])), SCHEMA)
    return out.repartition(4).persist()


def ortho(x):
    basis = np.linalg.qr(np.column_stack([np.ones_like(x), x, x**2]))[0]
    for j, power in ((1, x), (2, x**2)):
        basis[:, j] *= np.sign(basis[:, j] @ power)
    return basis[:, 1], basis[:, 2]


def numpy_design(keep=None):
    x, z, f, g, b, y = made()
    if keep is not None:
        x, z, f, b, y = x[g == keep], z[g == keep], f[g == keep], b[g == keep], y[g == keep]
    p1, p2 = ortho(x)
    cols = [np.ones_like(x), p1, p2, z, b * 1.0, (f == "b") * 1.0, (f == "c") * 1.0, p1 * z, p2 * z]
    return np.column_stack(cols), y


SPEC = D.Spec.of("y", D.crossing(D.Poly("x", 2), "z"), "b", D.Factor("f", ("a", "b", "c")))
NAMES = ["(Intercept)", "poly(x, 2)1", "poly(x, 2)2", "z", "bTRUE", "fb", "fc", "poly(x, 2)1:z", "poly(x, 2)2:z"]


def numpy_ols(X, y, hc1):
    inv = np.linalg.inv(X.T @ X)
    beta = inv @ X.T @ y
    e = y - X @ beta
    n, k = X.shape
    cov = inv @ (X.T * e**2) @ X @ inv * n / (n - k) if hc1 else inv * (e @ e) / (n - k)
    return beta, cov, e


@pytest.mark.parametrize("vcov", ["iid", "HC1"])
@pytest.mark.parametrize("keep", [None, "u", "v"])
def test_least_squares(data, vcov, keep):
    fit = R.ols(data, SPEC, slices=["g"] if keep else [], vcov=vcov)
    m = fit.models[(keep,) if keep else ()]
    X, y = numpy_design(keep)
    beta, cov, e = numpy_ols(X, y, vcov == "HC1")
    assert m.names == NAMES
    assert np.allclose(m.beta, beta, rtol=1e-8, atol=1e-9)
    assert np.allclose(m.cov, cov, rtol=1e-7, atol=1e-10)
    assert math.isclose(m.stats["r2"], 1 - e @ e / np.sum((y - y.mean()) ** 2), rel_tol=1e-9)


def test_polynomials_are_orthonormal_and_ignore_other_nulls(spark):
    x = made()[0]
    df = small_frame(spark, [(float(v), None if i % 3 else 1.0) for i, v in enumerate(x)], "x double, other double")
    got = np.array([(r["p1"], r["p2"]) for r in D.with_poly(df, "x", ["p1", "p2"]).orderBy("x").collect()])
    want = np.column_stack(ortho(np.sort(x)))
    assert np.allclose(got, want, atol=1e-9)


def test_polynomial_far_from_zero(spark):
    x = 1e6 + np.arange(50.0)
    df = small_frame(spark, [(v,) for v in x.tolist()], "x double")
    got = np.array([tuple(r) for r in D.with_poly(df, "x", ["p1", "p2"]).select("p1", "p2").collect()])
    assert np.allclose(got.T @ got, np.eye(2), atol=1e-9) and np.allclose(got.sum(axis=0), 0, atol=1e-7)


def test_too_few_values_for_a_square(frame):
    df = frame("x double, y double", (1.0, 1.0), (2.0, 2.0), (1.0, 3.0))
    with pytest.raises(ValueError, match="distinct"):
        R.ols(df, D.Spec.of("y", D.Poly("x", 2)))


def test_rows_with_a_null_are_left_out(frame):
    df = frame("x double, y double", (1.0, 1.0), (2.0, 2.5), (3.0, 2.0), (None, 9.0), (4.0, None), (float("nan"), 3.0))
    m = R.ols(df, D.Spec.of("y", "x")).models[()]
    assert m.n == 3 and np.allclose(m.beta, [5 / 6, 0.5])


def test_perfect_fit_and_no_freedom(frame):
    df = frame("x double, y double", (1.0, 5.0), (2.0, 7.0), (3.0, 9.0), (4.0, 11.0))
    m = R.ols(df, D.Spec.of("y", "x")).models[()]
    assert np.allclose(m.beta, [3, 2]) and m.stats["r2"] > 1 - 1e-12 and m.cov[1, 1] < 1e-20
    two = frame("x double, y double", (1.0, 5.0), (2.0, 7.0))
    full = report.coefficients(R.ols(two, D.Spec.of("y", "x"))).collect()
    assert [r["std_error"] for r in full] == [None, None] and np.allclose([r["estimate"] for r in full], [3, 2])


def test_collinear_term_is_dropped(frame):
    df = frame("x double, w double, y double", *[(float(i), 2.0 * i + 1, float(i * i)) for i in range(8)])
    m = R.ols(df, D.Spec.of("y", "x", "w")).models[()]
    assert m.dropped == ["w"] and np.isnan(m.beta[2]) and np.allclose(m.beta[:2], [-7, 7])


def test_residuals_are_orthogonal_to_the_design(data):
    fit = R.ols(data, SPEC)
    X, y = numpy_design()
    assert np.allclose(X.T @ (y - X @ fit.models[()].beta), 0, atol=1e-6)


def test_fixed_effects_match_dummies(data):
    x, z, f, g, b, y = made()
    result = R.ols_fixed(data, D.Spec.of("y", "x", "z"), "f")
    X = np.column_stack([np.ones_like(x), x, z, f == "b", f == "c"]).astype(float)
    beta, cov, e = numpy_ols(X, y, False)
    m = result.fit.models[()]
    assert np.allclose(m.beta[1:], beta[1:3]) and np.allclose(m.cov[1:, 1:], cov[1:3, 1:3])
    want = {"a": beta[0], "b": beta[0] + beta[3], "c": beta[0] + beta[4]}
    got = {r["f"]: r["intercept"] for r in result.groups.collect()}
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert m.stats["groups"] == 3 and m.df == len(y) - 5
    # Prediction with groups at their observed proportions.
    shares = np.array([np.mean(f == k) for k in ("b", "c")])
    d = np.array([1, 10.0, z.mean(), *shares])
    grid = P.predict(result.fit, small_frame(data.sparkSession, [(10.0,)], "x double")).first()
    se = math.sqrt(d @ cov @ d)
    assert math.isclose(grid["predicted"], d @ beta, rel_tol=1e-9)
    assert math.isclose(grid["conf_high"] - grid["predicted"], critical(0.95, m.df) * se, rel_tol=1e-7)


def binary(data):
    return data.withColumn("hit", F.col("y") > 6)


def test_logistic_score_is_zero(data):
    m = R.logit(binary(data), SPEC.__class__.of("hit", D.Poly("x", 2), "z", "b")).models[()]
    X, y = numpy_design()
    X, hit = X[:, :5], (y > 6) * 1.0
    p = 1 / (1 + np.exp(-X @ m.beta))
    assert np.allclose(X.T @ (hit - p), 0, atol=1e-6)
    assert np.allclose(m.cov, np.linalg.inv((X.T * (p * (1 - p))) @ X), rtol=1e-6)
    assert math.isclose(m.stats["loglik"], np.sum(hit * np.log(p) + (1 - hit) * np.log(1 - p)), rel_tol=1e-9)


def test_logistic_agrees_with_spark_ml(data):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    df = binary(data).withColumn("label", F.col("hit").cast("double"))
    ml = GeneralizedLinearRegression(family="binomial", tol=1e-10).fit(
        VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df)
    )
    m = R.logit(df, D.Spec.of("hit", "x", "z")).models[()]
    assert np.allclose(m.beta, [ml.intercept, *ml.coefficients], rtol=1e-5)


def test_separation_and_constant_outcomes_raise(frame):
    apart = frame("x double, y int", *[(float(i), int(i > 4)) for i in range(10)])
    with pytest.raises(R.SeparationError):
        R.logit(apart, D.Spec.of("y", "x"))
    same = frame("x double, y int", *[(float(i), 1) for i in range(10)])
    with pytest.raises(R.SeparationError):
        R.logit(same, D.Spec.of("y", "x"))


def test_no_slice_is_lost(frame):
    rows_in = [("a", float(i), float(2 * i + i % 3)) for i in range(12)] + [("flat", 5.0, float(i)) for i in range(4)]
    rows_in += [("empty", None, 1.0), ("empty", 2.0, None), (None, 1.0, 2.0), (None, 2.0, 5.0), (None, 4.0, 6.0), ("one", 1.0, 1.0)]
    df = frame("g string, x double, y double", *rows_in)
    fit = R.ols(df, D.Spec.of("y", D.Poly("x", 2)), slices=["g"])
    assert set(fit.models) == {("a",), (None,)}
    assert set(fit.unfitted) == {("flat",), ("empty",), ("one",)}
    assert {r["g"] for r in report.unfitted(fit).collect()} == {"flat", "empty", "one"}
    binary_rows = frame("g string, x double, y int", *[("mixed", float(i % 5), int(i % 3 == 0)) for i in range(30)], *[("apart", float(i), int(i > 4)) for i in range(10)], ("same", 1.0, 1))
    logit = R.logit(binary_rows, D.Spec.of("y", "x"), slices=["g"])
    assert set(logit.models) == {("mixed",)} and set(logit.unfitted) == {("apart",), ("same",)}


def test_many_slices_in_tables(frame, data):
    rng = np.random.default_rng(3)
    rows_in = []
    for g in range(300):
        n = int(rng.integers(0, 9))
        rows_in += [(g, float(rng.integers(0, 4)), None if g % 7 == 0 else float(rng.normal())) for _ in range(n)] or [(g, None, 1.0)]
    rows_in += [(None, float(i), float(i * i)) for i in range(5)]
    df = frame("g int, x double, y double", *rows_in)
    got = many.ols(df, D.Spec.of("y", "x"), ["g"]).collect()
    assert len(got) == 2 * len({r[0] for r in rows_in})
    for r in got:
        pairs = [(x, y) for g, x, y in rows_in if g == r["g"] and x is not None and y is not None]
        assert r["nobs"] == len(pairs)
        xs = {x for x, _ in pairs}
        assert r["status"] == ("no complete rows" if not pairs else "dropped terms" if len(xs) == 1 else "no freedom" if len(pairs) == 2 else "ok")
        if len(xs) > 1:
            slope, intercept = np.polyfit(*map(np.array, zip(*pairs)), 1)
            assert r["estimate"] == pytest.approx(intercept if r["term"] == "(Intercept)" else slope, abs=1e-9)
    plan = many.ols(df, D.Spec.of("y", "x"), ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan
    same = {(r["g"], r["term"]): r for r in many.ols(data, SPEC, ["g"]).collect()}
    for r in report.coefficients(R.ols(data, SPEC, slices=["g"])).collect():
        for c in ("estimate", "std_error", "p_value", "conf_low", "conf_high"):
            assert same[r["g"], r["term"]][c] == pytest.approx(r[c], rel=1e-6, abs=1e-9)


def test_odds_ratios(data):
    fit = R.logit(binary(data), D.Spec.of("hit", "z"))
    plain = {r["term"]: r for r in report.coefficients(fit).collect()}
    odds = {r["term"]: r for r in report.coefficients(fit, exponentiate=True).collect()}
    for term, r in odds.items():
        for c in ("estimate", "conf_low", "conf_high"):
            assert math.isclose(r[c], math.exp(plain[term][c]))
        assert r["p_value"] == plain[term]["p_value"]


def numpy_huber(X, y, k=1.345, tol=1e-4):
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ beta
    for _ in range(100):
        s = np.median(np.abs(e)) / 0.6745
        w = np.minimum(1, k * s / np.abs(e))
        beta = np.linalg.solve((X.T * w) @ X, (X.T * w) @ y)
        new = y - X @ beta
        done = np.sqrt(np.sum((e - new) ** 2) / np.sum(e**2)) <= tol
        e = new
        if done:
            break
    n, p = X.shape
    w = np.minimum(1, k * s / np.abs(e))
    core = np.abs(e) <= k * s
    kappa = 1 + p * np.var(core, ddof=1) / (n * core.mean() ** 2)
    sigma = np.sqrt(np.sum((w * e) ** 2) / (n - p)) * kappa / core.mean()
    return beta, sigma * np.sqrt(np.diag(np.linalg.inv(X.T @ X)))


@pytest.mark.parametrize("keep", [None, "u"])
def test_huber(data, keep):
    fit = R.huber(data, SPEC, slices=["g"] if keep else [])
    m = fit.models[(keep,) if keep else ()]
    beta, se = numpy_huber(*numpy_design(keep))
    assert np.allclose(m.beta, beta, rtol=1e-7, atol=1e-8)
    assert np.allclose(np.sqrt(np.diag(m.cov)), se, rtol=1e-6)
    assert m.stats["converged"] == 1.0


def test_huber_with_a_huge_bound_is_least_squares(data):
    a, b = R.huber(data, SPEC, k=1e9).models[()], R.ols(data, SPEC).models[()]
    assert np.allclose(a.beta, b.beta, rtol=1e-8)
    assert np.allclose(a.cov, b.cov, rtol=1e-6)


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 9 + [7.0], [3.0, 3.0, 4.0, 4.0], list(range(2001)), [1e-9, 1.0, 1e9, 1e12]])
def test_exact_medians(spark, values):
    rng = np.random.default_rng(0)
    pool = {"a": [float(v) for v in values], "b": rng.lognormal(0, 4, 501).tolist()}
    df = small_frame(spark, [(k, v) for k, vs in pool.items() for v in vs], "k string, v double")
    counts = {(k,): len(vs) for k, vs in pool.items()}
    got = R.medians(df, ["k"], F.col("v"), counts)
    assert all(math.isclose(got[(k,)], float(np.median(vs)), rel_tol=1e-15) for k, vs in pool.items())


def test_students_t():
    for t, df, want in [(2.228139, 10, 0.05), (12.7062, 1, 0.05), (1.959964, 1e9, 0.05), (0.0, 5, 1.0), (3.169273, 10, 0.01)]:
        assert math.isclose(t_two_sided(t, df), want, rel_tol=1e-4)
    for level, df in [(0.95, 3), (0.99, 40), (0.9, 1)]:
        assert math.isclose(t_two_sided(critical(level, df), df), 1 - level, rel_tol=1e-10)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_fits_do_not_depend_on_partitions(data, parts):
    a = R.ols(data.orderBy(F.rand(parts)).repartition(parts), SPEC, vcov="HC1").models[()]
    b = R.ols(data, SPEC, vcov="HC1").models[()]
    assert np.allclose(a.beta, b.beta, rtol=1e-9) and np.allclose(a.cov, b.cov, rtol=1e-8)


def test_predictions_hold_other_columns(data):
    fit = R.ols(data, SPEC)
    X, y = numpy_design()
    beta, cov, _ = numpy_ols(X, y, False)
    x, z, f, g, b, _ = made()
    basis = {float(v): (p, q) for v, p, q in zip(x, *ortho(x))}
    at = float(x[7])
    grid = P.with_levels(small_frame(data.sparkSession, [(at,)], "x double"), "z", [0.5, -1.0])
    p1, p2 = basis[at]
    for hold, rest in ((P.AT_PROPORTIONS, [b.mean(), np.mean(f == "b"), np.mean(f == "c")]), (P.AT_BASE, [0, 0, 0])):
        for r in P.predict(fit, grid, hold=hold).collect():
            d = np.array([1, p1, p2, r["z"], *rest, p1 * r["z"], p2 * r["z"]])
            assert math.isclose(r["predicted"], d @ beta, rel_tol=1e-8)
            margin = critical(0.95, len(y) - 9) * math.sqrt(d @ cov @ d)
            assert math.isclose(r["conf_high"] - r["conf_low"], 2 * margin, rel_tol=1e-7)


def test_logistic_predictions_are_probabilities(data):
    fit = R.logit(binary(data), D.Spec.of("hit", "x"))
    out = P.predict(fit, P.observed_grid(data, "x"))
    m = fit.models[()]
    for r in out.collect():
        assert 0 < r["conf_low"] < r["predicted"] < r["conf_high"] < 1
        assert math.isclose(r["predicted"], 1 / (1 + math.exp(-(m.beta[0] + m.beta[1] * r["x"]))), rel_tol=1e-9)


def test_value_grid(data):
    got = rows(P.value_grid(data, "x", 40, 46, 2, per=["g"]))
    assert got == [(g, float(v)) for g in "uv" for v in (40, 42, 44, 46)]


def test_labels_and_side_by_side(data):
    fit = R.ols(data, D.Spec.of("y", "x", "z"), slices=["g"])
    labels = {"z": "Second", "x": "First", "absent": "Never"}
    table = report.side_by_side(report.label_terms(report.coefficients(fit), labels), "g", ["u", "v"])
    assert [r["label"] for r in table.collect()] == ["Second", "First"]
    assert report.fit_stats(fit, omit="AIC|BIC|log").columns == ["g", "nobs", "r2", "adj_r2", "rmse"]


def test_one_spec_many_estimators(data):
    spec = D.Spec.of("hit", "x", "z")
    kinds = {e: R.fit(binary(data), spec, e).models[()] for e in ("ols", "hc1", "logit", "huber")}
    assert np.allclose(kinds["ols"].beta, kinds["hc1"].beta)
    assert all(np.sign(m.beta[2]) == 1 for m in kinds.values())


def _slices_of(rng, count=60):
    out = []
    for g in range(count):
        n = int(rng.integers(1, 40))
        x, z = rng.normal(size=n).round(2), rng.integers(0, 3, n).astype(float)
        y = 1 + 2 * x - z + rng.standard_t(2, n)
        out += [(g, float(a), float(b), float(c), f"h{i % 3}") for i, (a, b, c) in enumerate(zip(x, z, y))]
    return out


def _same(got, fit, df_slices, names=("estimate", "std_error", "p_value", "conf_low", "conf_high"), rel=1e-6):
    known = {(r["g"], r["term"]): r for r in report.coefficients(fit).collect()}
    compared = 0
    for r in got:
        if r["status"] == "ok":
            for c in names:
                want = known[r["g"], r["term"]][c]
                assert r[c] == pytest.approx(want, rel=rel, abs=1e-7), (r, c)
            compared += 1
    return compared


def test_many_robust_and_fixed(frame):
    rows_in = _slices_of(np.random.default_rng(5)) + [(None, float(i % 5), float(i % 2), float(i % 7), "h") for i in range(30)] + [(99, None, 1.0, 1.0, "h")]
    df = frame("g int, x double, z double, y double, h string", *rows_in)
    spec = D.Spec.of("y", "x", "z")
    got = many.hc1(df, spec, ["g"]).collect()
    assert _same(got, R.ols(df, spec, ["g"], vcov="HC1"), df) > 100
    assert {r["status"] for r in got if r["g"] == 99} == {"no complete rows"}
    got = many.fixed(df, spec, "h", ["g"]).collect()
    assert _same(got, R.ols_fixed(df, spec, "h", ["g"]).fit, df) > 100
    poly = D.Spec.of("y", D.Poly("x", 2), "z")
    assert _same(many.ols(df, poly, ["g"]).collect(), R.ols(df, poly, ["g"]), df) > 100


def test_many_huber(frame):
    rows_in = _slices_of(np.random.default_rng(6), 40) + [(77, float(i), 0.0, 3.0 * i, "h") for i in range(8)]
    df = frame("g int, x double, z double, y double, h string", *rows_in)
    spec = D.Spec.of("y", "x", "z")
    got = many.huber(df, spec, ["g"], max_steps=6).collect()
    fit = R.huber(df, spec, ["g"], max_steps=6)
    good = [r for r in got if fit.models[r["g"],].stats["converged"] and r["nobs"] > 4 and r["g"] != 77]
    assert _same(good, fit, df, ("estimate", "std_error"), 1e-5) > 15
    assert {r["status"] for r in got} >= {"ok", "not converged", "no freedom"}
    assert len({r["g"] for r in got}) == len({r[0] for r in rows_in})


def _rounded(found):
    return rows(found.select(*[F.round(c, 7).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes]))


def test_small_slices_take_their_steps_in_one_shuffle(frame, monkeypatch):
    """Packed slices, tables and both at once give the same fits; packed ones need no job a step."""
    rows_in = _slices_of(np.random.default_rng(9), 60) + [(None, float(i % 5), float(i % 2), float(i % 7), "h") for i in range(30)]
    rows_in += [(99, None, 1.0, 1.0, "h"), (98, 1.0, float("nan"), 1.0, "h"), *[(97, 0.1, 1.0, float(i % 3), "h") for i in range(7)]]
    df = frame("g int, x double, z double, y double, h string", *rows_in).withColumn("up", (F.col("y") > F.col("x")).cast("int"))
    status = df.sparkSession.sparkContext.statusTracker()
    for name, fit in (("huber", lambda: many.huber(df, D.Spec.of("y", "x", "z"), ["g"], max_steps=6)), ("logit", lambda: many.logit(df, D.Spec.of("up", "x"), ["g"]))):
        df.sparkSession.sparkContext.setJobGroup(name, name)
        found = _rounded(fit())
        assert len(status.getJobIdsForGroup(name)) < 8
        assert len(found) > 100 and {r[0] for r in found} == {r[0] for r in rows_in}
        for size in (0, 60):
            monkeypatch.setattr(many, "PACKED", size)
            assert _rounded(fit()) == found
        monkeypatch.setattr(many, "PACKED", 1024)


def test_pieces_hold_whole_slices(frame, monkeypatch):
    """Batches cut into pieces of few numbers lose no slice."""
    df = frame("g int, x double, y double", *[(g, float(i), float((i * 7 + g) % 5)) for g in range(40) for i in range(g % 9)])
    want = _rounded(many.huber(df, D.Spec.of("y", "x"), ["g"]))
    monkeypatch.setattr(many, "PIECE", 12)
    assert _rounded(many.huber(df, D.Spec.of("y", "x"), ["g"])) == want


def test_brackets_hold_exact_medians(spark, monkeypatch):
    monkeypatch.setattr(many, "SMALL", 3)
    monkeypatch.setattr(many, "BINS", 8)
    rng = np.random.default_rng(1)
    values = {g: np.round(rng.exponential(size=int(rng.integers(1, 60))), 2 if g % 2 else 6) for g in range(40)}
    left = {g: (0.5, 0.9) if g % 3 else (0.0, 9.0) for g in values}
    found = {}
    for _ in range(30):
        rows_in = [(g, float(v), len(values[g]), *left[g]) for g in left for v in values[g]]
        df = spark.createDataFrame(rows_in, "g int, v double, n long, lo double, hi double")
        for r in many._medians(df, ["g"]).collect():
            if r["median"] is None:
                left[r["g"]] = (r["new_lo"], r["new_hi"])
            else:
                found[r["g"]] = r["median"]
                left.pop(r["g"])
        if not left:
            break
    assert found == {g: pytest.approx(np.median(v)) for g, v in values.items()}


def _separable(x, y):
    """Is there a line with no row on its wrong side and some row off it?  All directions that rows can decide, one regressor or two."""
    points = [np.array([1.0, *np.atleast_1d(v)]) for v in x]
    signs = [1 if v else -1 for v in y]
    k = len(points[0])
    candidates = [np.eye(k)[i] * s for i in range(k) for s in (1, -1)]
    for pair in itertools.combinations(points, k - 1):
        normal = np.linalg.svd(np.array(pair))[2][-1]
        candidates += [normal, -normal]
    for c in candidates:
        side = np.array([s * (p @ c) for s, p in zip(signs, points)])
        if side.min() >= -1e-9 and side.max() > 1e-6:
            return True
    return False


def test_many_logit_finds_separation(frame):
    rng = np.random.default_rng(8)
    rows_in = []
    for g in range(250):
        n = int(rng.integers(3, 12))
        x, z = rng.integers(0, 4, n), rng.integers(0, 4, n)
        y = (x + rng.normal(size=n) * rng.choice([0.01, 1, 4]) > 1.5).astype(int)
        rows_in += [(g, float(a), float(b), int(c)) for a, b, c in zip(x, z, y)]
    rows_in += [(500, 1.0, 1.0, 3), (501, None, 1.0, 1)]
    df = frame("g int, x double, z double, y int", *rows_in)
    for spec, take in ((D.Spec.of("y", "x"), 1), (D.Spec.of("y", "x", "z"), 2)):
        got = many.logit(df, spec, ["g"]).collect()
        by = {}
        for r in got:
            by.setdefault(r["g"], []).append(r)
        seen = {"separated": 0, "fitted": 0}
        for g in range(250):
            part = [r for r in rows_in if r[0] == g]
            x, y = [r[1 : 1 + take] for r in part], [r[3] for r in part]
            status = by[g][0]["status"]
            if len(set(y)) == 1:
                assert status == "the outcome is constant"
            elif _separable(x, y) and status != "dropped terms":
                seen["separated"] += 1
                assert status == "separated" and any(r["separates"] for r in by[g]) and by[g][0]["estimate"] is None
            elif status == "ok":
                seen["fitted"] += 1
                b = [r["estimate"] for r in sorted(by[g], key=lambda r: ["(Intercept)", "x", "z"].index(r["term"]))]
                design = np.c_[np.ones(len(x)), np.array(x)]
                p = 1 / (1 + np.exp(-design @ b))
                assert np.abs(design.T @ (np.array(y) - p)).max() < 1e-6
        assert min(seen.values()) > 10
        assert by[500][0]["status"] == "the outcome is not 0 or 1" and by[501][0]["status"] == "no complete rows"
    whole = many.logit(df.where("y < 2"), D.Spec.of("y", "x", "z"), ["y"]).collect()
    assert {r["status"] for r in whole} == {"the outcome is constant"}


def test_predictions_from_tables(frame):
    rows_in = _slices_of(np.random.default_rng(4), 12) + [(50, 2.0, 1.0, 3.0, "h"), (51, None, 1.0, 3.0, "h")]
    df = frame("g int, x double, z double, y double, h string", *rows_in)
    spec = D.Spec.of("y", D.Num("x"), D.Factor("h", ("h0", "h1", "h2")))
    fitted = many.models(df, spec, ["g"])
    grid = frame("g int, x double, h string, beta string", *[(g, 0.5, h, "own") for g in [*range(12), 50, 51, 99] for h in ("h0", "h2")], (1, None, "h0", "own"))
    got = many.predict(fitted, grid, spec, ["g"]).collect()
    assert len(got) == 31 and got[0].__fields__ == ["g", "x", "h", "beta", "predicted", "std_error", "conf_low", "conf_high"]
    fit = R.ols(df, spec, ["g"])
    for r in got:
        model = fit.models.get((r["g"],))
        if model is None or r["x"] is None:
            assert r["predicted"] is None
            continue
        x = np.array([1.0, r["x"], float(r["h"] == "h1"), float(r["h"] == "h2")])
        use = ~np.isnan(model.beta)
        if model.df > 0 and use.all():
            assert r["predicted"] == pytest.approx(x @ model.beta, abs=1e-8) and r["std_error"] == pytest.approx(np.sqrt(x @ model.cov @ x), abs=1e-8)
            assert r["conf_high"] - r["predicted"] == pytest.approx(critical(0.95, model.df) * r["std_error"], abs=1e-7)
