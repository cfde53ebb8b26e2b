"""CSV trees with drifting headers, stages and dimensions."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from civicframe import session
from civicframe.operators import groups
from civicframe.sources import csvtree
from civicframe.sources.tables import Stage, demographics, dimension, load


@pytest.fixture
def tree(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")

    write("TX/bills.csv", 'bill_id,title,year\n1,"a, b",2021\n2,,2020\n3,NA,\n')
    write("TX/sponsors.csv", "bill_id,people_id\n1,9\n")
    write("NY/x/bills.csv", "title,bill_id\nzero,007\n")
    write("NY/y/bills.csv", "bill_id,title,year,extra\n8,t,12A,e\n")
    write("NY/y/rollbills.csv", "bill_id\n99\n")
    return str(tmp_path)


TYPES = {"bill_id": "long", "year": "long"}


def test_union_by_name(spark, tree):
    got = csvtree.scan_csv_tree(spark, tree, "bills?csv*", TYPES)
    assert set(got.columns) == {"bill_id", "title", "year", "extra", "file"}
    assert rows(got, "bill_id", "title", "year", "extra") == [
        (1, "a, b", 2021, None), (2, "", 2020, None), (3, None, None, None), (7, "zero", None, None), (8, "t", None, "e"),
    ]


def test_siblings_share_a_path(spark, tree):
    bills = csvtree.scan_csv_tree(spark, tree, "bills?csv*", TYPES)
    sponsors = csvtree.sibling_path(csvtree.scan_csv_tree(spark, tree, "sponsors?csv*", TYPES), "sponsors", "bills")
    both = bills.join(sponsors.withColumnRenamed("bill_id", "b"), "file")
    assert rows(both.select("bill_id").distinct()) == [(1,), (2,), (3,)]


def test_first_in_source_order(spark, tree):
    got = csvtree.scan_csv_tree(spark, tree, "bills?csv*", TYPES, order="at")
    ordered = [r["bill_id"] for r in got.orderBy("at").collect()]
    assert ordered == [1, 2, 3, 7, 8] or ordered == [7, 8, 1, 2, 3]
    folder = F.regexp_extract("file", "/(TX|NY)/", 1).alias("folder")
    first = groups.first_per_group(got.select("*", folder), ["folder"], [F.col("at")])
    assert rows(first, "folder", "bill_id") == [("NY", 7), ("TX", 1)]


def test_large_file_is_split_but_has_one_header(spark, tmp_path):
    path = tmp_path / "big" / "bills.csv"
    path.parent.mkdir()
    path.write_text("id,v\n" + "".join(f"{i},{'x' * 50}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        assert list(csvtree.headers(spark, str(tmp_path / "big"), "*.csv")) == [("id", "v")]
        got = csvtree.scan_csv_tree(spark, str(tmp_path / "big"), "*.csv", {"id": "long"}, order="at")
        assert got.rdd.getNumPartitions() > 4
        assert got.count() == 20000
        first = groups.first_per_group(got.withColumn("k", F.lit(1)), ["k"], [F.col("at")])
        assert first.first()["id"] == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_file(spark, tree):
    with pytest.raises(FileNotFoundError):
        csvtree.scan_csv_tree(spark, tree, "nothing*")


def test_declared_single_file_prunes_columns(spark, tree):
    got = csvtree.scan_csv(spark, f"{tree}/TX/bills.csv", {"bill_id": "long", "title": "string", "year": "long"}, select=["year"])
    assert rows(got) == [(None,), (2020,), (2021,)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<year:string>" in plan


def test_positions(spark, tree):
    raw = csvtree.scan_csv(spark, f"{tree}/TX/bills.csv", {"bill_id": "long", "title": "string", "year": "long"})
    assert rows(csvtree.pick_positions(raw, {"y": 3, "id": 1})) == [(None, 3), (2020, 2), (2021, 1)]


def test_csv_round_trip(spark, frame, tmp_path):
    df = frame("a int, b string", (1, "x,y"), (2, 'q"t'), (3, "plain"))
    csvtree.write_csv(df, str(tmp_path / "out"))
    back = csvtree.scan_csv_tree(spark, str(tmp_path / "out"), "part*", {"a": "int"}).drop("file")
    assert rows(back) == rows(df)


def test_quoted_text_of_another_writer(spark, tmp_path):
    folder = tmp_path / "a b" / "x{1}[2]"
    folder.mkdir(parents=True)
    (folder / "bills.csv").write_text('"bill_id","the ""title"", quoted",n\n1,"An act ""to amend"", voting",5\n2," padded ",6\n3,"",7\n')
    got = csvtree.scan_csv_tree(spark, str(tmp_path), "bills?csv*", {"bill_id": "long", "n": "int"})
    assert got.columns == ["bill_id", 'the "title", quoted', "n", "file"]
    assert rows(got.drop("file")) == [(1, 'An act "to amend", voting', 5), (2, " padded ", 6), (3, "", 7)]


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "t.csv").write_text('id,text\n1,"one\ntwo, ""three"""\n2,plain\n')
    assert rows(csvtree.unbalanced(spark, str(tmp_path / "d"), "*.csv"), "line") == [('1,"one',), ('two, ""three"""',)]
    got = csvtree.scan_csv_tree(spark, str(tmp_path / "d"), "*.csv", {"id": "int"}, multi_line=True).drop("file")
    assert rows(got) == [(1, 'one\ntwo, "three"'), (2, "plain")]


def test_written_text_is_standard(spark, frame, tmp_path):
    import csv

    texts = ['q"t', "x,y", "two\nlines", " blanks ", "", "plain"]
    csvtree.write_csv(frame("i int, b string", *enumerate(texts)).coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part*")
    with part.open(newline="") as f:
        assert [r["b"] for r in sorted(csv.DictReader(f), key=lambda r: int(r["i"]))] == texts
    back = csvtree.scan_csv(spark, str(tmp_path / "out"), {"i": "int", "b": "string"}, multi_line=True)
    assert rows(back) == [*enumerate(texts)]


def test_declared_layouts_need_no_header_pass(spark, tree):
    layouts = {"TX": ["bill_id", "title", "year"], "NY/y": ["bill_id", "title", "year", "extra"]}
    got = csvtree.scan_csv_tree(spark, tree, "bills.csv", TYPES, layouts=layouts)
    assert rows(got, "bill_id", "extra") == [(1, None), (2, None), (3, None), (8, "e")]


def test_stage_prunes_folders(spark, frame, tmp_path):
    stage = Stage(spark, str(tmp_path))
    df = frame("GEOID string, level string, year int, nh double", ("1", "state", 2020, 0.5), ("2", "state", 2010, 0.6), ("3", "upper", 2020, 0.7))
    stage.write(df, "demo", ["level", "year"])
    got = demographics(stage.read("demo"), "state", 2020, {"GEOID": "GEOID", "nh_white": "nh"})
    assert rows(got) == [("1", 0.5)]
    assert "PartitionFilters: [isnotnull(level" in got._jdf.queryExecution().executedPlan().toString()


def test_dimension(frame):
    df = frame("abbr string, name string, county string", ("TX", "Texas", "1"), ("TX", "Texas", "2"))
    assert rows(dimension(df, ["abbr", "name"])) == [("TX", "Texas")]


def test_scan_reads_only_the_columns_used(spark):
    orders = load(spark, "/root/testdata/sf0.001", "orders")
    plan = orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan and "EqualTo(o_orderstatus,F)" in plan


def test_scratch_follows_the_session(spark):
    assert session.scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert os.path.basename(session.scratch_dir(spark)).startswith("civicframe-")
