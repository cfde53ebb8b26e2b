"""Natural breaks against brute force, and labels."""

from itertools import combinations

import numpy as np
import pytest
from conftest import rows

from civicframe.models import classify


def cost(groups):
    return sum(np.sum((np.asarray(g) - np.mean(g)) ** 2) for g in groups)


def brute(values, classes):
    distinct = sorted(set(values))
    best = None
    for ends in combinations(range(len(distinct) - 1), classes - 1):
        limits = [distinct[e] for e in ends]
        cuts = [-np.inf, *limits, np.inf]
        groups = [[v for v in values if a < v <= b] for a, b in zip(cuts, cuts[1:])]
        total = round(cost(groups), 9)
        if best is None or (total, limits) < best:
            best = (total, limits)
    return [distinct[0], *best[1], distinct[-1]]


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("classes", [2, 3, 4])
def test_breaks_are_optimal(seed, classes):
    values = np.random.default_rng(seed).integers(0, 40, 30).tolist()
    distinct, counts = np.unique(values, return_counts=True)
    assert classify.fisher_breaks(distinct, counts, classes) == brute(values, classes)


def test_ties_take_the_smallest_limits():
    assert classify.fisher_breaks([0, 1, 2, 3], [1, 1, 1, 1], 3) == [0, 0, 1, 3]


def test_few_distinct_values():
    assert classify.fisher_breaks([2, 5], [3, 1], 4) == [2, 2, 5]


def test_breaks_from_rows(frame):
    df = frame("x int", *[(v,) for v in [1, 1, 2, 9, 10, 30, 31, None, 80]])
    assert classify.jenks_breaks(df, "x", 4) == [1, 2, 10, 31, 80]
    assert classify.jenks_breaks(df, "x", 2, round_to=10) == [0, 30, 80]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("classes", [2, 3, 5])
def test_breaks_over_ranges_are_those_over_values(frame, monkeypatch, seed, classes):
    rng = np.random.default_rng(seed)
    kinds = [
        np.concatenate([rng.normal(m, 3, 300) for m in (0, 40, 90)] + [np.full(50, 40.5)]),
        rng.random(1500) ** 3,  # no gaps: many limits cost nearly the same
        np.concatenate([rng.integers(0, 60, 900), [10_000.0]]),
    ]
    values = kinds[seed].tolist()
    df = frame("x double", *[(float(v),) for v in values])
    distinct, counts = np.unique(values, return_counts=True)
    monkeypatch.setattr(classify, "RANGES", 16)
    assert classify.jenks_breaks(df, "x", classes) == classify.fisher_breaks(distinct, counts, classes)


def test_fewer_values_than_classes(frame):
    few = frame("x double", *[(float(v),) for v in range(5)] * 4)
    assert classify.jenks_breaks(few, "x", 3) == classify.fisher_breaks(range(5), [4] * 5, 3)
    assert classify.jenks_breaks(few, "x", 9) == [0, 0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        classify.jenks_breaks(few.limit(0), "x", 3)


def test_bounds_never_shut_out_the_optimum():
    rng = np.random.default_rng(7)
    for _ in range(200):
        x = np.sort(rng.choice([rng.integers(0, 30, 24).astype(float), rng.random(24) * 10]))
        classes = int(rng.integers(2, 5))
        cuts = [0, *np.sort(rng.choice(np.arange(1, 24), 6, replace=False)), 24]
        cuts = [c for c in cuts if c in (0, 24) or x[c - 1] < x[c]]
        bins = [{"n": j - i, "s": x[i:j].sum(), "q": (x[i:j] ** 2).sum(), "low": x[i], "high": x[j - 1]} for i, j in zip(cuts, cuts[1:])]
        found = classify._limits(bins, classes)
        wide = np.array([b["low"] < b["high"] for b in bins])
        at_end, inside = classify._through(bins, classes, wide, found)
        distinct, counts = np.unique(x, return_counts=True)
        best = classify.fisher_breaks(distinct, counts, classes)
        for limit in best[1:-1] if len(distinct) > classes else []:
            i = next(k for k, b in enumerate(bins) if limit <= b["high"])
            assert at_end[i] if limit == bins[i]["high"] else inside[i]


def test_labels(frame):
    df = frame("x int", (0,), (5,), (6,), (13,))
    got = rows(classify.with_classes(df, "x", [0.0, 5.0, 13.0]))
    assert got == [(0, 1, "[0,5]", "0-5"), (5, 1, "[0,5]", "0-5"), (6, 2, "(5,13]", "6-13"), (13, 2, "(5,13]", "6-13")]
