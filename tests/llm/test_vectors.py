"""Whitening and top-k search against plain numpy."""

import math

import numpy as np
import pyarrow as pa
import pytest

from civicframe.llm import norm_topk, spectrum_whiten
from civicframe.llm.common import table
from civicframe.llm.vectors import integers

FOLDER = "/root/testdata/sf0.001"


def plain(rows, scale):
    """Usable vectors as whole numbers."""
    out = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(scale * float(x)) for x in v]))
    return out


def slow_whiten(rows, components):
    kept = plain(rows, 1024)
    x = np.array([v for _, v in kept], float) + 100_000
    mean = x.mean(axis=0)
    cov = (x - mean).T @ (x - mean) / len(x)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    return kept, (x - mean) @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov), vectors[:, order]


def test_integers_leave_out_unusable_vectors():
    col = pa.array([[0.5, -0.3], None, [None, 1.0], [float("nan"), 0], [float("inf"), 0], [1.0], [], [1e30, 0]], pa.list_(pa.float64()))
    kept, x = integers(col, 10, 2, 2.0**62)
    assert kept.tolist() == [0, 5, 6] and x.tolist() == [[5, -3], [10, 0], [0, 0]]


@pytest.mark.parametrize("kind", ["random", "repeated", "low rank", "zero", "one"])
def test_leading_eigenvalues_are_numbered_and_exact(kind):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 30))
    q = np.linalg.qr(a)[0]
    values = {
        "random": np.sort(rng.random(30))[::-1], "repeated": np.array([5.0] * 4 + [3.0] * 3 + [1.0] * 23), "low rank": np.array([2.0, 1, 1e-3] + [0.0] * 27),
        "zero": np.zeros(30), "one": np.full(30, 7.0),
    }[kind]
    m = q @ np.diag(values) @ q.T
    m = (m + m.T) / 2
    got, vectors = spectrum_whiten.leading(m, 8)
    assert np.allclose(got, values[:8], atol=1e-12) and np.allclose(vectors @ vectors.T, np.eye(8), atol=1e-9)
    assert np.abs(m @ vectors.T - vectors.T * got).max() < 1e-11
    for s in (-1.0, 0.5, 2.5, 4.0, 9.0):
        assert spectrum_whiten.above(m, s) == (values > s).sum()


def test_exact_products_beyond_doubles():
    z = np.array([[2**40 + 1, 3], [-(2**41) + 7, 2**50 + 1]])
    want = [[sum(int(r[i]) * int(r[j]) for r in z) for j in range(2)] for i in range(2)]
    assert spectrum_whiten.exact_products(z).tolist() == want


def test_whitening_matches_numpy(spark):
    docs = table(spark, FOLDER, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in docs.collect()]
    kept, want, explained, _ = slow_whiten(rows, 8)
    got = spectrum_whiten.apply(docs.repartition(3)).collect()
    assert len(got) == 8 * len(kept)
    n = len(kept)
    x = [[v + 100_000 for v in vec] for _, vec in kept]
    sums = [sum(c) for c in zip(*x)]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(vec, sums)) for (i, _), vec in zip(kept, x)}
    at = {(r["vec_id"], r["component"]): r for r in got}
    white = np.array([[at[i, c]["whitened"] for c in range(1, 9)] for i, _ in kept])
    sign = np.sign((white * want).sum(axis=0))
    assert np.allclose(white, want * sign, atol=1e-7)
    for r in got:
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-9
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9


def test_whitening_of_odd_rows(spark):
    kind = "vec_id long, embedding array<double>, component int"
    rows = [(1, [1.0, 2.0, 3.0], 9), (1, [1.0, 2.0, 3.0], 9), (None, [2.0], 9), (2**53 + 1, [], 9), (4, None, 9), (5, [None, 1.0, 2.0], 9), (6, [float("nan")], 9)]
    docs = spark.createDataFrame(rows, kind).coalesce(1)
    got = spectrum_whiten.apply(docs).collect()
    assert [r["vec_id"] for r in got[::3]] == [1, 1, None, 2**53 + 1] and len(got) == 12
    assert [r["whitened"] is None for r in got[:3]] == [False, False, True] and got[0]["identity_error"] < 1e-9
    assert spectrum_whiten.apply(docs.limit(0)).count() == 0
    alike = spectrum_whiten.apply(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in alike} == {(None, None, None, 0)}
    huge = spectrum_whiten.apply(spark.createDataFrame([(i, [1e15 * i, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")).collect()
    assert huge[0]["deviation"] is None and abs(huge[0]["whitened"]) > 1


def slow_search(rows, top, every):
    kept = sorted({(i, tuple(v)) for i, v in plain(rows, 256) if i is not None})
    width = max((len(v) for _, v in kept), default=0)
    pad = [(i, v + (0,) * (width - len(v))) for i, v in kept]
    out = []
    for i, q in pad:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in pad if j != i)
            out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:top])]
    return sorted(out)


def test_search_matches_brute_force(spark):
    docs = table(spark, FOLDER, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in docs.collect()]
    got = sorted(map(tuple, norm_topk.search(docs.repartition(4), every=10, query_bytes=256 * 20).collect()))
    assert got == slow_search(rows, 5, 10)


def test_search_with_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) * 0.25]) for i in range(300)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 900)] + [(i, [0.0] * 6) for i in range(900, 920)]
    rows += [(0, [9.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (5, rows[5][1]), (None, [50.0] * 6), (1000, None), (1010, [None, 1.0]), (1020, [float("inf")]), (1030, [2.0]), (1040, []), (1050, [1e9] * 6)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = slow_search([r for r in rows if r[0] != 1050], 5, 5)
    assert sorted(map(tuple, norm_topk.search(docs, every=5).collect())) == want
    assert norm_topk.search(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in norm_topk.search(one).collect()] == [(50, 1, 51, 256 * 512)]


def test_bounds_leave_out_most_pairs():
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((6000, 32)) * np.linspace(300, 5, 32) * rng.random((6000, 1))).astype(np.int64)
    x = x[np.argsort(-(x * x).sum(axis=1), kind="stable")]
    axes = np.linalg.svd(x.astype(float), full_matrices=False)[2].T
    ids, q = np.arange(len(x)), x[::60]
    found = norm_topk.Search(ids[::60], norm_topk.Rotated(q, axes), 5, np.full(len(q), norm_topk._LEAST))
    for low in range(0, len(x), 500):
        found.add(ids[low : low + 500], norm_topk.Rotated(x[low : low + 500], axes))
    for k, i in enumerate(ids[::60]):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        assert found.best_id[k].tolist() == order and found.best[k].tolist() == score[order].tolist()
    assert found.exact < len(q) * len(x) / 3
