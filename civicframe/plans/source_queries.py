"""Queries that write tables as drifting CSV files and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import groups, joins
from ..session import scratch_dir
from ..sources import csvtree
from ..sources.tables import Stage, demographics, without_geometry
from .registry import Tables, query, rounded
from .spatial_queries import zones

#: Dump folder -> (segments, header of its bills file).
DUMPS = {
    "dump_a": (("AUTOMOBILE", "BUILDING"), {"bill_id": "c_custkey", "title": "c_name", "amount": "c_acctbal", "state": "c_nationkey"}),
    "dump_b": (("FURNITURE", "HOUSEHOLD"), {"state": "c_nationkey", "bill_id": "c_custkey", "note": "c_mktsegment", "title": "c_name"}),
    "dump_c": (("MACHINERY",), {"bill_id": "c_custkey", "title": "c_name", "state": "c_nationkey"}),
}
TYPES = {"bill_id": "long", "amount": "double", "state": "long", "people": "long"}


def _write_dumps(t: Tables) -> str:
    root = scratch_dir(t.spark)
    # Some texts are empty and some read NA, which must come back apart.
    title = F.when(F.col("c_acctbal") < -500, "").when(F.col("c_acctbal") < 0, "NA").otherwise(F.col("c_name"))
    customers = t.customer.withColumn("c_name", title)
    for dump, (segments, header) in DUMPS.items():
        rows = customers.filter(F.col("c_mktsegment").isin(*segments))
        csvtree.write_csv(rows.select(*[F.col(c).alias(n) for n, c in header.items()]), f"{root}/{dump}/bills")
        people = rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("people"))
        csvtree.write_csv(people.withColumnRenamed("c_nationkey", "state"), f"{root}/{dump}/people")
    return root


@query(
    "csv_multi_file",
    """
    WITH c AS (SELECT *, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'dump_a' WHEN c_mktsegment = 'MACHINERY' THEN 'dump_c' ELSE 'dump_b' END AS dump FROM customer)
    SELECT dump || '/bills' AS dump, c_custkey AS bill_id, CASE WHEN c_acctbal < -500 THEN '' WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS title,
           CASE WHEN dump = 'dump_a' THEN c_acctbal END AS amount, CASE WHEN dump = 'dump_b' THEN c_mktsegment END AS note,
           CAST(c_nationkey AS BIGINT) AS state, count(*) OVER (PARTITION BY dump, c_nationkey) AS people
    FROM c
    """,
)
def csv_multi_file(t: Tables) -> DataFrame:
    root = _write_dumps(t)
    bills = csvtree.scan_csv_tree(t.spark, f"{root}/*/bills", "part?*csv", TYPES)
    people = csvtree.sibling_path(csvtree.scan_csv_tree(t.spark, f"{root}/*/people", "part?*csv", TYPES), "people", "bills")
    # The folder, not the part file, is the unit that sibling files share.
    folder = F.regexp_extract("file", "(dump_[a-z]/bills)", 1)
    bills, people = (df.withColumn("dump", folder).drop("file") for df in (bills, people))
    return joins.left_join(bills, people, ["dump", "state"])


@query(
    "csv_positions_first",
    """
    SELECT id, seg FROM (SELECT c_custkey AS id, lower(c_mktsegment) AS seg,
                                row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn = 1
    """,
)
def csv_positions_first(t: Tables) -> DataFrame:
    """Positional columns of a ';'-separated file, then the first row per group in file order."""
    path = f"{scratch_dir(t.spark)}/sorted"
    # The test tables have no file order of their own, so one is written.
    t.customer.orderBy("c_custkey").write.option("header", True).option("sep", ";").csv(path)
    layout = {"c_custkey": "long", "c_name": "string", "c_nationkey": "long", "c_acctbal": "double", "c_mktsegment": "string"}
    rows = csvtree.scan_csv_tree(t.spark, path, "part?*csv", layout, sep=";", order="at")
    named = csvtree.pick_positions(rows, {"id": 1, "nation": 3, "Seg Ment": 5, "at": 7})
    first = groups.first_per_group(text.snake_names(named), ["seg_ment", "nation"], [F.col("at")])
    return first.select("id", F.lower("seg_ment").alias("seg"))


@query(
    "stage_demographics",
    """
    SELECT n_nationkey AS "GEOID", count(*) AS population, round(avg(c_acctbal), 4) AS income
    FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1
    """,
)
def stage_demographics(t: Tables) -> DataFrame:
    """A stage partitioned by level and year; reading one of each prunes to one folder."""
    stage = Stage(t.spark, scratch_dir(t.spark))
    facts = t.customer.groupBy(F.col("c_mktsegment").alias("level"), "c_nationkey").agg(
        F.count(F.lit(1)).alias("people"), F.avg("c_acctbal").alias("income")
    )
    stage.write(facts.withColumn("year", F.lit(2020)), "demographics", ["level", "year"])
    picked = demographics(
        stage.read("demographics"), "BUILDING", 2020, {"GEOID": "c_nationkey", "population": "people", "income": "income"}
    )
    shapes = without_geometry(zones(t)).select(F.col("zone").alias("GEOID"))
    out = joins.left_join(shapes, picked, ["GEOID"]).dropna(subset=["population"])
    return out.select("GEOID", "population", rounded("income", 4).alias("income"))


@query(
    "csv_quoted_text",
    "SELECT page_id AS id, url AS title, html AS text, length(html) AS n FROM pages UNION ALL SELECT doc_id, source, text, length(text) FROM documents",
)
def csv_quoted_text(t: Tables) -> DataFrame:
    """Texts with quotes, commas and line breaks, written as CSV and read back whole."""
    root = scratch_dir(t.spark)
    pages = t.pages.select(F.col("page_id").alias("id"), F.col("url").alias("title"), F.col("html").alias("text"))
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text")
    csvtree.write_csv(pages, f"{root}/raw pages")
    csvtree.write_csv(docs.select("id", "text", "title"), f"{root}/documents")
    layouts = {"raw pages": ["id", "title", "text"], "documents": ["id", "text", "title"]}
    rows = csvtree.scan_csv_tree(t.spark, root, "part*csv", {"id": "long"}, multi_line=True, layouts=layouts)
    return rows.select("id", "title", "text", F.length("text").cast("long").alias("n"))


@query("csv_pruned", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(*) AS n FROM lineitem GROUP BY 1")
def csv_pruned(t: Tables) -> DataFrame:
    """Two of a wide file's columns; the others are not parsed."""
    path = f"{scratch_dir(t.spark)}/lineitem"
    csvtree.write_csv(t.lineitem, path)
    layout = {n: "long" if n == "l_linenumber" else "string" for n in t.lineitem.columns}
    rows = csvtree.scan_csv(t.spark, path, layout, select=["l_returnflag", "l_linenumber"])
    return rows.groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("lines"), F.count(F.lit(1)).alias("n"))
