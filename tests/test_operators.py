"""Joins, overrides, groups and recodes on hand-written rows, and under skew."""

import datetime

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from civicframe.functions import text
from civicframe.operators import aggregate, groups, joins, recode
from civicframe.plans import catalog
from civicframe.plans import study_values as V
from civicframe.sources.local import small_frame


def test_override_compares_columns_not_joined_text(frame):
    base = frame("bill string, year string, v int", ("a", "bc", 1), ("ab", "c", 2), ("x", None, 3), ("y", None, 4))
    new = frame("bill string, year string, note string", ("ab", "c", "new"), ("x", None, "also"))
    got = rows(joins.override(base, new, ["bill", "year"]), "bill", "year", "v", "note")
    assert got == [("a", "bc", 1, None), ("ab", "c", None, "new"), ("x", None, None, "also"), ("y", None, 4, None)]


def test_corrections_ignore_empty_text(frame):
    df = frame("k int, bill string", (1, "a"), (2, "b"), (3, "c"))
    fix = frame("k int, bill2 string", (1, "A"), (2, ""))
    assert rows(joins.correct(df, fix, ["k"], {"bill": "bill2"}, expect="one")) == [(1, "A"), (2, "b"), (3, "c")]


def test_repeated_right_keys_are_reported(frame):
    a, b = frame("k int", (1,)), frame("k int, v int", (1, 1), (1, 2))
    with pytest.raises(ValueError, match="repeat"):
        joins.left_join(a, b, ["k"], expect="one")
    assert len(rows(joins.left_join(a, b, ["k"]))) == 2


def test_dimension_members_without_facts_get_zero(frame):
    dim = frame("name string", ("Vermont",), ("Texas",))
    facts = frame("state string, n int", ("Texas", 4))
    assert rows(joins.fill_from_dimension(dim, facts, [("name", "state")], ["n"])) == [("Texas", 4), ("Vermont", 0)]


def test_primary_wins_over_fallback(frame):
    first = frame("g string, v double", ("a", 0.1), ("b", None))
    second = frame("g string, v double", ("a", 0.9), ("b", 0.8), ("c", 0.7))
    assert rows(joins.prefer_first(first, second, ["g"], "v")) == [("a", 0.1), ("b", 0.8), ("c", 0.7)]


def skewed(spark, n=3000):
    """A third of all rows under one key, another key null."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40 + 10)
    return spark.range(n).select(key.cast("int").alias("k"), "id")


@pytest.mark.parametrize("salt", [1, 8])
def test_salted_join_returns_the_same_rows(spark, salt):
    left = skewed(spark)
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = joins.left_join(left, right, ["k"], salt=salt)
    assert got.columns == ["k", "id", "n"]
    assert rows(got) == rows(joins.left_join(left, right, ["k"]))
    assert got.count() == 3000


def test_group_values_match_a_window(spark):
    from pyspark.sql import Window

    df = skewed(spark)
    got = groups.with_inverse_size(df, ["k"])
    want = df.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("k")))
    assert rows(got) == rows(want)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_totals_do_not_gather_a_group(spark):
    plan = plan_of(groups.with_share(skewed(spark), ["k"], "id"))
    assert "Window" not in plan and "partial_sum" in plan


def test_first_per_group_limits_before_the_shuffle(spark):
    plan = plan_of(groups.first_per_group(skewed(spark), ["k"], groups.nulls_last("id")))
    exchange, partial = plan.index("Exchange hashpartitioning"), plan.rindex("WindowGroupLimit")
    assert partial > exchange, plan


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_results_do_not_depend_on_partitions_or_order(spark, parts):
    df = skewed(spark).orderBy(F.rand(3)).repartition(parts)
    first = groups.first_per_group(df, ["k"], groups.nulls_last("id"))
    low = skewed(spark).groupBy("k").agg(F.min("id").alias("id"))
    assert rows(first) == rows(low)
    numbered = groups.with_row_number(df, "id")
    assert rows(numbered, "id", "row_id") == [(i, i + 1) for i in range(3000)]
    assert rows(groups.with_row_number_of_text(df, "id"), "id", "row_id") == [(i, i + 1) for i in range(3000)]


def test_row_numbers_with_ties_and_nulls(frame):
    df = frame("x double, y string", (1.0, "b"), (None, "z"), (1.0, "a"), (0.5, "c"), (7.0, None))
    assert rows(groups.with_row_number(df, "x", "y"), "row_id", "x", "y") == [
        (1, None, "z"), (2, 0.5, "c"), (3, 1.0, "a"), (4, 1.0, "b"), (5, 7.0, None),
    ]
    days = df.selectExpr("date_add(date'2020-01-01', cast(x AS int)) AS d", "y").filter("d IS NOT NULL")
    assert [r[0] for r in rows(groups.with_row_number(days, "d", "y"), "row_id")] == [1, 2, 3, 4]
    plan = groups.with_row_number(df, "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan


def test_relabel_of_shared_seats(frame):
    df = frame("seat int, party string, n int", (1, "R", 2), (2, "R", 1), (2, "D", 3), (3, None, 4))
    assert rows(groups.relabel_mixed(df, ["seat"], "party", "M", ["n"])) == [(1, "R", 2), (2, "M", 4), (3, None, 4)]


def test_stacked_grains_keep_the_null_key(frame):
    df = frame("upper string, lower string, v int", ("u", "l", 1), ("u", None, 2), (None, "l", 4))
    got = rows(aggregate.stack_grains(df, {"SD": "upper", "HD": "lower"}, [F.sum("v").alias("v")]))
    assert got == [(None, "HD", 2), (None, "SD", 4), ("l", "HD", 5), ("u", "SD", 3)]


def test_share_with_a_missing_party(frame):
    df = frame("d int, r int", (1, 3), (None, 3), (0, 0))
    assert rows(df.select(aggregate.share_of("d", ["d", "r"]).alias("s"))) == [(None,), (None,), (0.25,)]


def test_categories_end_with_other(frame):
    df = frame("g string, n int", ("Other", 99), ("a", 1), ("b", 5))
    assert [r["g"] for r in aggregate.ranked_categories(df, "g", "n", "Other").collect()] == ["b", "a", "Other"]


BILLS = [
    ("FL", "H0061", "HB61"), ("IN", "HB0012", "HB12"), ("IL", "HJR0004", "HJR0004"), ("IL", "HB0004", "HB4"),
    ("NY", "A00123", "AB123"), ("RI", "S0045", "S45"), ("FL", "H12A", "H12A"), ("FL", "S77B", "S77B"), ("TX", "HB0001", "HB0001"), ("TN", "HJR0001", "HJR0001"),
]


def test_bill_numbers(frame):
    df = frame("state string, n string, want string", *BILLS)
    got = df.select("state", "n", text.strip_leading_zeros(F.col("n"), F.col("state"), V.NUMBERS_2021).alias("got"), "want")
    assert [(s, n, g) for s, n, g, _ in rows(got)] == [(s, n, w) for s, n, _, w in rows(got)]


def test_scopes_may_not_overlap():
    rule = text.NumberRule(("A",), keep=1)
    with pytest.raises(ValueError):
        text.strip_leading_zeros(F.lit("x"), F.lit("A"), [rule, rule])


KEYS = [
    ("Rhode Island", "RI HB5", "RI H5"), ("Pennsylvania", "PA HCB3", "PA HB3"), ("North Dakota", "ND HB1234", "ND 1234"),
    ("Maine", "ME HP104/LD148", "ME LD148"), ("North Carolina", "NC HJR330", "NC H330"), ("Connecticut", "CT HRJ5", "CT HJ5"),
    ("Texas", "TX SB1", "TX SB1"), (None, "FL HJR61", "FL HB61"),
]


def test_ordered_keys(frame):
    df = frame("state string, bill_merge string, want string", *KEYS)
    got = recode.recode(df, "bill_merge", V.KEY_RULES_2021)
    assert rows(got.filter("not (bill_merge <=> want)")) == []


def test_exact_rules_feed_each_other():
    chain = [recode.Exact("a", "b"), recode.Exact("b", "c"), recode.Exact("c", "a"), recode.Exact("x", "y")]
    # Each start runs through the rules in order.
    assert recode.compose_exact(chain) == {"b": "a", "c": "a", "x": "y"}
    assert recode.dependent_rules(chain) == [(0, 1), (1, 2)]


def test_composed_rules_equal_rules_one_by_one(frame):
    df = frame("state string, bill_merge string, want string", *KEYS, ("x", "a", ""), ("x", "b", ""), ("x", None, ""))
    rules = [recode.Exact("a", "b"), recode.Exact("b", "TX SB1"), recode.Swap("bill_merge like 'TX%'", "S", "H"), recode.Exact("TX HB1", "z")]
    slow = df
    for rule in rules:
        slow = recode.recode(slow, "bill_merge", [rule])
    assert rows(recode.recode(df, "bill_merge", rules)) == rows(slow)


def test_dead_rules_show_zero_hits(frame):
    df = frame("state string, bill_merge string", ("North Carolina", "NC HB119"), ("Florida", "FL HJR61"))
    hits = {r["rule"]: r["hits"] for r in recode.rule_hits(df, "bill_merge", V.KEY_RULES_2021).collect()}
    dead = [i for i, r in enumerate(V.KEY_RULES_2021) if r == recode.Exact("NC HB119", "NC H119")][0]
    alive = [i for i, r in enumerate(V.KEY_RULES_2021) if r == recode.Exact("FL HJR61", "FL HB61")][0]
    # The letter is dropped by an earlier rule, so the exact one can never apply.
    assert hits[dead] == 0 and hits[alive] == 1 and len(hits) == len(V.KEY_RULES_2021)


def test_years_are_unknown_without_a_date_in_one_state(frame):
    rows_in = [
        ("Texas", "TX HB9", "2020", None), ("Texas", "TX HB9", "2020", "2021-03-01"), ("Texas", "TX HB9", "2020", "2021-01-05"),
        ("Ohio", "OH HB9", "2020", None), ("Texas", "TX HB304", "2021", "2020-12-01"), ("Texas", "TX HB82", "2021", "2021-01-01"),
        ("Virginia", "VA HB1746", "2021", None),
    ]
    df = frame("state string, bill_merge string, year string, d string", *rows_in).withColumn("date_added", F.col("d").cast("date"))
    got = recode.recode(df, "year", V.YEAR_RULES_2021)
    assert rows(got, "bill_merge", "year") == [
        ("OH HB9", "2020"), ("TX HB304", "2021"), ("TX HB82", "2021 (S)"), ("TX HB9", None), ("TX HB9", "2020"), ("TX HB9", "2021"),
        ("VA HB1746", "2020"),
    ]


def test_filters_above_many_rules_stay_small(frame):
    df = frame("state string, bill_merge string, year string, date_added date", ("Texas", "TX HB304", "2021", None))
    got = recode.recode(recode.recode(df, "bill_merge", V.KEY_RULES_2021), "year", V.YEAR_RULES_2021)
    got = joins.left_join(got.filter(V.NOT_BILLS), df.select("bill_merge", F.lit(1).alias("n")), ["bill_merge"], null_safe=False)
    assert len(got.filter("year <> ''")._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_literals_are_escaped(frame):
    df = frame("k string", ("a'b",), ("c\\d",), ("e5",))
    rules = [recode.Exact("a'b", "it's"), recode.Exact("c\\d", "\\"), recode.Swap("k like 'e%'", "\\d", "'")]
    assert rows(recode.recode(df, "k", rules)) == [("\\",), ("e'",), ("it's",)]


def test_unsafe_literals_are_refused():
    with pytest.raises(ValueError):
        recode.in_list("x", ["a'b"])


def test_unmatched_rows_are_listed(frame):
    a, b = frame("k int", (1,), (2,), (None,)), frame("k int", (1,), (None,))
    assert rows(joins.unmatched(a, b, ["k"])) == [(2,)]


def test_unique_check(frame):
    assert one(joins.repeated_keys(frame("k int", (1,), (1,), (2,)), ["k"]))["rows"] == 2


def test_scaled_sums_do_not_depend_on_where_rows_lie(spark, tmp_path):
    """In the files' order 0.7 + 0.2 + 0.1 is 0.9999999999999999; a task for each file adds 0.7 and 0.2 + 0.1, which is 1."""
    kinds = "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderdate timestamp"
    (tmp_path / "orders.parquet").mkdir()
    for i, prices in enumerate([[0.7], [0.2, 0.1]]):
        part = [(k, 5, p, "F", datetime.datetime(2000, 1, 1, tzinfo=datetime.UTC)) for k, p in enumerate(prices)]
        small_frame(spark, part, kinds).coalesce(1).sortWithinPartitions("o_orderkey").write.parquet(str(tmp_path / str(i)))
        next((tmp_path / str(i)).glob("*.parquet")).rename(tmp_path / "orders.parquet" / f"{i}.parquet")
    assert one(catalog.QUERIES["scale_columns"](spark, str(tmp_path)))["new_text"] == "0"
