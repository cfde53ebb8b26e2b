"""Null, text, number and date rules, one test per rule."""

import math

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from civicframe.functions import nulls, numeric, text
from civicframe.functions.weights import weighted_mean_of_sums, weighted_sums
from civicframe.models import classify
from civicframe.operators import groups, joins, reshape


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_null_keys_match_and_can_be_kept_apart(frame):
    a = frame("k string, x int", ("a", 1), (None, 2))
    b = frame("k string, y int", ("a", 10), (None, 20))
    assert rows(joins.left_join(a, b, ["k"])) == [(None, 2, 20), ("a", 1, 10)]
    assert rows(joins.left_join(a, b, ["k"], null_safe=False)) == [(None, 2, None), ("a", 1, 10)]


def test_conditional_propagates_null(frame):
    df = frame("x int", (1,), (5,), (None,))
    out = df.select(nulls.if_else_na(F.col("x") > 2, F.lit("big"), F.lit("small")).alias("v"))
    assert rows(out) == [(None,), ("big",), ("small",)]


def test_multi_branch_falls_through_null(frame):
    df = frame("x int", (None,), (1,))
    assert rows(df.select(F.when(F.col("x") > 0, "a").otherwise("b").alias("v"))) == [("a",), ("b",)]


def test_not_in_keeps_null(frame):
    df = frame("s string", ("a",), ("b",), (None,))
    assert rows(df.filter(nulls.not_in(F.col("s"), ["a"]))) == [(None,), ("b",)]


def test_strict_aggregates(frame):
    df = frame("g string, x int", ("a", 1), ("a", None), ("b", 3), ("b", 2), ("c", None))
    out = df.groupBy("g").agg(nulls.strict(F.min, F.col("x")).alias("low"), F.min("x").alias("loose"))
    assert rows(out) == [("a", None, 1), ("b", 2, 2), ("c", None, None)]


def test_strict_group_minimum_on_rows(frame):
    df = frame("g string, x int", ("a", 1), ("a", None), ("b", 3), ("b", 2), (None, 7))
    out = rows(groups.with_strict_min(df, ["g"], "x"))
    assert out == [(None, 7), ("a", None), ("a", None), ("b", 2), ("b", 2)]


def test_paste_writes_na(spark):
    assert value(spark, nulls.paste(F.lit("TX"), F.lit(None).cast("string"))) == "TX NA"


@pytest.mark.parametrize(
    "raw,want", [("12", 12), ("012", 12), ("12.0", 12), ("12A", None), ("12D", None), ("", None), (" 7 ", 7), ("-3", -3), (None, None)]
)
def test_safe_whole_numbers(spark, raw, want):
    assert value(spark, nulls.to_int(F.lit(raw).cast("string"))) == want


def test_division_by_zero_is_null(frame):
    df = frame("k string, v double", ("a", 0.0), ("a", 0.0), ("b", 1.0), ("b", 3.0))
    assert rows(groups.with_share(df, ["k"], "v"), "k", "share") == [("a", None), ("a", None), ("b", 0.25), ("b", 0.75)]


def test_dates_that_do_not_parse(spark):
    assert str(value(spark, text.parse_date(F.lit("2/3/2021"), "M/d/yyyy"))) == "2021-02-03"
    assert value(spark, text.parse_date(F.lit("n/a"), "M/d/yyyy")) is None
    assert value(spark, text.year_or_text(F.lit(None).cast("date"), F.lit("2020-11-30"))) == 2020


def test_overlay(frame):
    df = frame("a string, b string", ("x", "y"), ("", "y"), (None, "y"))
    assert rows(df.select(nulls.overlay(F.col("a"), F.col("b")).alias("v"))) == [("x",), ("y",), ("y",)]


WEIGHTED = [
    ("null x", [(1.0, 1.0), (None, 3.0), (3.0, 1.0)], 2.0, None),
    ("null x with weight 0", [(1.0, 1.0), (None, 0.0), (3.0, 3.0)], 2.5, 2.5),
    ("all null", [(None, 1.0)], None, None),
    ("no weight", [(1.0, 0.0), (2.0, 0.0)], None, None),
    ("equal weights", [(1.0, 2.0), (2.0, 2.0), (6.0, 2.0)], 3.0, 3.0),
    ("null weight", [(1.0, None), (2.0, 1.0)], None, None),
    ("null both", [(None, None), (2.0, 1.0)], 2.0, None),
]


@pytest.mark.parametrize("case", WEIGHTED, ids=[c[0] for c in WEIGHTED])
@pytest.mark.parametrize("skip", [True, False])
def test_weighted_means(frame, case, skip):
    _, data, loose, tight = case
    df = frame("x double, w double", *data)
    want = loose if skip else tight
    assert one(df.agg(nulls.weighted_mean(F.col("x"), F.col("w"), skip).alias("m")))["m"] == want
    # The same in two stages, whatever the split.
    parts = df.groupBy((F.coalesce("x", F.lit(0.0)) > 1).alias("h")).agg(*weighted_sums(F.col("x"), F.col("w"), skip))
    assert one(parts.agg(weighted_mean_of_sums().alias("m")))["m"] == want


def test_sort_puts_null_last(frame):
    df = frame("g int, s int, v string", (1, None, "late"), (1, 5, "first"), (2, None, "only"))
    assert rows(groups.first_per_group(df, ["g"], groups.nulls_last("s", "v")), "g", "v") == [(1, "first"), (2, "only")]


def test_bins_are_right_closed(frame):
    df = frame("x double", (0.0,), (5.0,), (5.5,), (10.0,), (13.0,), (13.5,), (None,))
    got = rows(df.select("x", classify.cut(F.col("x"), [0, 5, 10, 13]).alias("c")))
    assert got == [(None, None), (0.0, 1), (5.0, 1), (5.5, 2), (10.0, 2), (13.0, 3), (13.5, None)]


def test_same_named_columns_are_refused(frame):
    a, b = frame("k int, x int", (1, 1)), frame("k int, x int", (1, 2))
    with pytest.raises(ValueError, match="both sides"):
        joins.left_join(a, b, ["k"])


def test_widen_fills_absent_cells_only(frame):
    df = frame("id int, f string, v int", (1, "a", None), (1, "b", 2), (2, "a", 3), (3, None, 9))
    wide = reshape.widen(df, ["id"], "f", ["a", "b"], ["v"], fill=0)
    assert rows(wide) == [(1, None, 2), (2, 3, 0), (3, 0, 0)]


def test_widen_refuses_two_rows_per_cell(frame):
    df = frame("id int, f string, v int", (1, "a", 1), (1, "a", 2))
    with pytest.raises(Exception, match="two rows for one cell"):
        reshape.widen(df, ["id"], "f", ["a"], ["v"]).collect()


def test_pivot_then_unpivot_returns_the_input(frame):
    df = frame("id int, f string, v int", (1, "a", 1), (1, "b", 2), (2, "a", 3), (2, "b", 4))
    back = reshape.lengthen(reshape.widen(df, ["id"], "f", ["a", "b"], ["v"]), ["id"], ["a", "b"], "f", "v")
    assert rows(back) == rows(df)


def test_log_of_zero_is_null(spark):
    assert value(spark, F.ln(F.lit(0.0))) is None


def test_padding_never_cuts(spark):
    assert value(spark, text.pad_left(F.lit("42"), 5)) == "00042"
    assert value(spark, text.pad_left(F.lit("1234567"), 5)) == "1234567"


def test_characters_and_segments(spark):
    assert value(spark, text.chars(F.lit("https://legis.com/TX/b"), 19, 20)) == "TX"
    assert value(spark, text.chars(F.lit("HB12"), 3)) == "12"
    assert value(spark, text.last_segment(F.lit("a/b/99"))) == "99"
    assert value(spark, text.last_segment(F.lit("99"))) == "99"
    assert value(spark, text.last_char(F.lit("012A"))) == "A"
    assert value(spark, text.ends_with_capital(F.lit("012a"))) is False


def test_number_text(spark):
    assert value(spark, numeric.grouped_number(F.lit("1,234,567"))) == 1234567
    assert value(spark, text.thousands(F.lit(1234567))) == "1,234,567"
    assert value(spark, text.percent(F.lit(0.655), 1)) == "65.5%"
    assert value(spark, text.percent(F.lit(0.65))) == "65%"
    assert value(spark, text.ratio_cell(F.lit(3), F.lit(5))) == "3 / 5"
    assert value(spark, text.ratio_cell(F.lit(0), F.lit(0))) is None


def test_open_interval_excludes_both_ends(spark):
    for x, want in [(0.45, False), (0.5, True), (0.55, False)]:
        assert value(spark, numeric.strictly_between(F.lit(x), 0.45, 0.55)) is want


def test_split_into_positions(frame):
    df = frame("d string", ("HD-12",), ("SD-A",), ("HD-012A-1",), ("HD",), (None,))
    got = rows(text.split_columns(df, "d", "-", 3), "d_1", "d_2", "d_3")
    assert got == [(None, None, None), ("HD", None, None), ("HD", "012A", "1"), ("HD", "12", None), ("SD", "A", None)]


def test_snake_names(frame):
    df = frame("a int", (1,)).select(*[F.col("a").alias(n) for n in ("House URL", "2020 share", "a.b", "A b")])
    assert text.snake_names(df).columns == ["house_url", "x2020_share", "a_b", "a_b_2"]


def test_row_sum_and_change(frame):
    df = frame("p_a int, p_b int", (1, 2), (None, 2))
    assert rows(df.select(numeric.row_sum(numeric.by_prefix(df, "p_")).alias("v"))) == [(None,), (3,)]
    ratio = numeric.relative_change(F.lit(3.0), F.lit(2.0))
    assert math.isclose(one(df.limit(1).select(ratio.alias("v")))["v"], 0.5)
