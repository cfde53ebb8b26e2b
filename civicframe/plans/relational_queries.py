"""Queries over joins, groups, recodes and reshapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..functions.nulls import if_else_na, not_in, overlay, paste, strict, to_int
from ..functions.weights import weighted_mean_of_sums, weighted_sums
from ..operators import aggregate, groups, joins, recode, reshape
from ..sources.local import small_frame
from ..sources.tables import dimension
from .registry import Tables, query, rounded

PLAIN = {"null_safe": False}


def provisions_by_customer(t: Tables) -> DataFrame:
    """Orders counted per customer, all and finished: aggregated before any join."""
    flags = aggregate.total_and_subset(F.lit(1), F.col("o_orderstatus") == "F", "intro", "passed")
    return t.orders.groupBy("o_custkey").agg(*flags)


@query(
    "state_panel",
    """
    WITH facts AS (
      SELECT c_nationkey, count(*) AS intro, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS passed
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)
    SELECT n_name, n_regionkey, CAST(coalesce(intro, 0) AS BIGINT) AS intro,
           CAST(coalesce(passed, 0) AS BIGINT) AS passed,
           round(coalesce(intro, 0) / nullif(sum(coalesce(intro, 0)) OVER (PARTITION BY n_regionkey), 0), 6) AS share
    FROM nation LEFT JOIN facts ON n_nationkey = c_nationkey
    """,
)
def state_panel(t: Tables) -> DataFrame:
    by_customer = joins.left_join(
        provisions_by_customer(t), t.customer.select("c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")], **PLAIN
    )
    by_nation = by_customer.groupBy("c_nationkey").agg(*aggregate.sum_each(["intro", "passed"]))
    panel = joins.fill_from_dimension(t.nation, by_nation, [("n_nationkey", "c_nationkey")], ["intro", "passed"])
    shares = groups.with_share(panel, ["n_regionkey"], "intro", small_groups=True)
    return shares.select("n_name", "n_regionkey", "intro", "passed", rounded("share").alias("share"))


@query(
    "dedupe_first_ordered",
    """
    SELECT user_id, event_type, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts NULLS LAST, event_id) AS rn
      FROM events) WHERE rn = 1
    """,
)
def dedupe_first_ordered(t: Tables) -> DataFrame:
    first = groups.first_per_group(t.events.drop("props"), ["user_id", "event_type"], groups.nulls_last("ts", "event_id"))
    return first.select("user_id", "event_type", "event_id", "value")


@query(
    "dedupe_first_source",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
      FROM lineitem) WHERE rn = 1
    """,
)
def dedupe_first_source(t: Tables) -> DataFrame:
    slim = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return groups.first_per_group(slim, ["l_orderkey"], groups.nulls_last("l_linenumber", "l_partkey", "l_suppkey"))


@query(
    "override_merge",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS note
    FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderpriority IS NULL
    UNION ALL
    SELECT o_orderkey, o_custkey, 'X', NULL, 'rushed' FROM orders WHERE o_orderpriority = '1-URGENT'
    """,
)
def override_merge(t: Tables) -> DataFrame:
    base = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    replacement = urgent.select(
        "o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"), F.lit("rushed").alias("note")
    )
    merged = joins.override(base, replacement, ["o_orderkey", "o_custkey"])
    return merged.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "note")


#: (name, brand, corrected name, corrected key); '' means "leave as is".
CORRECTIONS = [
    ("small ring", "Brand#1", "tiny ring", ""),
    ("red widget", "Brand#17", "", "K-17"),
    ("blue bolt", "Brand#4", "navy bolt", "K-4"),
    ("hot gear", "Brand#9", None, None),
    ("small bolt", "Brand#2", "", None),
]


@query(
    "correction_overlay",
    """
    WITH fix(p_name, p_brand, name2, key2) AS (VALUES
      ('small ring', 'Brand#1', 'tiny ring', ''), ('red widget', 'Brand#17', '', 'K-17'),
      ('blue bolt', 'Brand#4', 'navy bolt', 'K-4'), ('hot gear', 'Brand#9', NULL, NULL),
      ('small bolt', 'Brand#2', '', NULL)),
    patched AS (
      SELECT p_partkey, p_type, p_size, p_brand, p_name,
             coalesce(nullif(name2, ''), p_name) AS new_name,
             coalesce(nullif(key2, ''), p_brand || '-' || p_size) AS part_code
      FROM part LEFT JOIN fix USING (p_name, p_brand))
    SELECT p_partkey, new_name AS p_name, part_code,
           CASE WHEN new_name = 'navy bolt' AND p_type = 'SMALL' THEN 'patched' ELSE p_type END AS p_type
    FROM patched
    """,
)
def correction_overlay(t: Tables) -> DataFrame:
    fixes = small_frame(t.spark, CORRECTIONS, "p_name string, p_brand string, name2 string, key2 string")
    parts = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    joined = joins.left_join(parts, fixes, ["p_name", "p_brand"], expect="one")
    joined = joined.withColumn("p_name", overlay(F.col("name2"), F.col("p_name")))
    computed = F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))
    joined = joined.withColumn("part_code", F.coalesce(F.nullif("key2", F.lit("")), computed))
    patch = [recode.Assign("p_name = 'navy bolt' and p_type = 'SMALL'", "patched")]
    return recode.recode(joined, "p_type", patch).select("p_partkey", "p_name", "part_code", "p_type")


@query(
    "unmatched_report",
    "SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)",
)
def unmatched_report(t: Tables) -> DataFrame:
    """Documents that nobody has labelled."""
    return joins.unmatched(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


SEGMENT_RULES = [
    text.NumberRule(scopes=("FURNITURE",), keep=1, insert="B"),
    text.NumberRule(scopes=("MACHINERY", "BUILDING"), keep=2, unless=("CX",), unless_scopes=("BUILDING",)),
    text.NumberRule(scopes=("HOUSEHOLD",), keep=1),
]


@query(
    "key_normalise",
    """
    WITH raw AS (
      SELECT c_custkey, c_mktsegment, substr(c_name, 10) AS digits,
             CASE WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'C' WHEN c_acctbal < 0 THEN 'CX' ELSE 'CB' END
               || CASE WHEN c_acctbal > 9900 THEN 'A' ELSE '' END AS head
      FROM customer),
    ids AS (SELECT *, head || digits AS id, CAST(CAST(digits AS BIGINT) AS VARCHAR) AS num, right(head, 1) = 'A' AS bad FROM raw)
    SELECT c_custkey, c_mktsegment || ' ' || CASE
        WHEN bad THEN id
        WHEN c_mktsegment = 'FURNITURE' THEN 'CB' || num
        WHEN c_mktsegment = 'HOUSEHOLD' THEN 'C' || num
        WHEN c_mktsegment = 'MACHINERY' OR (c_mktsegment = 'BUILDING' AND head NOT LIKE 'CX%') THEN head || num
        ELSE id END AS bill_merge,
      CASE WHEN NOT bad THEN CAST(digits AS BIGINT) END AS number
    FROM ids
    """,
)
def key_normalise(t: Tables) -> DataFrame:
    one_letter = F.col("c_mktsegment").isin("FURNITURE", "HOUSEHOLD")
    head = F.when(one_letter, "C").when(F.col("c_acctbal") < 0, "CX").otherwise("CB")
    # A stray letter before the digits makes the number unreadable.
    stray = F.when(F.col("c_acctbal") > 9900, "A").otherwise("")
    raw = t.customer.select(
        "c_custkey", "c_mktsegment", F.length(head).alias("at"),
        F.concat(head, stray, text.chars(F.col("c_name"), 10)).alias("id"),
    )
    clean = text.strip_leading_zeros(F.col("id"), F.col("c_mktsegment"), SEGMENT_RULES)
    merged = text.trim_blank(paste(F.col("c_mktsegment"), clean))
    number = to_int(F.substring(F.col("id"), F.col("at") + 1, F.length("id")))
    return raw.select("c_custkey", merged.alias("bill_merge"), number.alias("number"))


KEY_RULES = [
    recode.Exact("PROMO Brand#1", "PROMO Brand#2"),
    recode.Exact("PROMO Brand#2", "LARGE Brand#3"),
    recode.Swap("key like 'SMALL %'", "Brand#", "B"),
    recode.Exact("SMALL B7", "MEDIUM Brand#7"),
    recode.Compute("key like 'ECONOMY %'", "concat(substring(key, 1, 3), substring(key, 8))"),
    recode.Exact("NOSUCH Brand#1", "never"),
    recode.Swap("p_size > 40 and key like 'LARGE %'", " ", "_"),
]
SIZE_RULES = [
    recode.Assign(recode.in_list("key", ["LARGE Brand#3", "MEDIUM Brand#7", "ECO Brand#5"]), "listed"),
    recode.Assign("band = 'mid' and p_type = 'PROMO'", "promo"),
    recode.Assign("limit_price > 950 and band = 'mid'", "dear", strict=True),
    recode.Assign("key rlike '^SMALL B1[0-9]$'", "small-teen"),
]

_RECODE_SQL = """
    WITH k0 AS (
      SELECT p_partkey, p_type, p_size, p_type || ' ' || p_brand AS key,
             CASE WHEN p_brand <> 'Brand#25' THEN p_retailprice END AS limit_price,
             CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 30 THEN 'mid' ELSE 'high' END AS band FROM part),
    k1 AS (SELECT * REPLACE (CASE WHEN key = 'PROMO Brand#1' THEN 'PROMO Brand#2' ELSE key END AS key), key = 'PROMO Brand#1' AS h0 FROM k0),
    k2 AS (SELECT * REPLACE (CASE WHEN key = 'PROMO Brand#2' THEN 'LARGE Brand#3' ELSE key END AS key), key = 'PROMO Brand#2' AS h1 FROM k1),
    k3 AS (SELECT * REPLACE (CASE WHEN key LIKE 'SMALL %' THEN replace(key, 'Brand#', 'B') ELSE key END AS key), key LIKE 'SMALL %' AS h2 FROM k2),
    k4 AS (SELECT * REPLACE (CASE WHEN key = 'SMALL B7' THEN 'MEDIUM Brand#7' ELSE key END AS key), key = 'SMALL B7' AS h3 FROM k3),
    k5 AS (SELECT * REPLACE (CASE WHEN key LIKE 'ECONOMY %' THEN substr(key, 1, 3) || substr(key, 8) ELSE key END AS key), key LIKE 'ECONOMY %' AS h4 FROM k4),
    k6 AS (SELECT *, key = 'NOSUCH Brand#1' AS h5 FROM k5),
    k7 AS (SELECT * REPLACE (CASE WHEN p_size > 40 AND key LIKE 'LARGE %' THEN replace(key, ' ', '_') ELSE key END AS key), (p_size > 40 AND key LIKE 'LARGE %') AS h6 FROM k6)
"""


def _recode_input(t: Tables) -> DataFrame:
    band = F.when(F.col("p_size") < 10, "low").when(F.col("p_size") < 30, "mid").otherwise("high")
    return t.part.select(
        "p_partkey", "p_type", "p_size", F.concat_ws(" ", "p_type", "p_brand").alias("key"),
        F.when(F.col("p_brand") != "Brand#25", F.col("p_retailprice")).alias("limit_price"), band.alias("band"),
    )


@query(
    "ordered_recode",
    _RECODE_SQL
    + """,
    s1 AS (SELECT * REPLACE (CASE WHEN key IN ('LARGE Brand#3', 'MEDIUM Brand#7', 'ECO Brand#5') THEN 'listed' ELSE band END AS band) FROM k7),
    s2 AS (SELECT * REPLACE (CASE WHEN band = 'mid' AND p_type = 'PROMO' THEN 'promo' ELSE band END AS band) FROM s1),
    s3 AS (SELECT * REPLACE (CASE WHEN (limit_price > 950 AND band = 'mid') IS NULL THEN NULL
                                  WHEN limit_price > 950 AND band = 'mid' THEN 'dear' ELSE band END AS band) FROM s2)
    SELECT p_partkey, key, CASE WHEN regexp_matches(key, '^SMALL B1[0-9]$') THEN 'small-teen' ELSE band END AS band
    FROM s3
    """,
)
def ordered_recode(t: Tables) -> DataFrame:
    keyed = recode.recode(_recode_input(t), "key", KEY_RULES)
    return recode.recode(keyed, "band", SIZE_RULES).select("p_partkey", "key", "band")


@query(
    "zero_hit_rules",
    _RECODE_SQL
    + """
    , sums AS (SELECT count(*) FILTER (h0) AS r0, count(*) FILTER (h1) AS r1, count(*) FILTER (h2) AS r2,
                      count(*) FILTER (h3) AS r3, count(*) FILTER (h4) AS r4, count(*) FILTER (h5) AS r5,
                      count(*) FILTER (h6) AS r6 FROM k7)
    SELECT 0 AS rule, r0 AS hits FROM sums UNION ALL SELECT 1, r1 FROM sums UNION ALL SELECT 2, r2 FROM sums
    UNION ALL SELECT 3, r3 FROM sums UNION ALL SELECT 4, r4 FROM sums UNION ALL SELECT 5, r5 FROM sums
    UNION ALL SELECT 6, r6 FROM sums
    """,
)
def zero_hit_rules(t: Tables) -> DataFrame:
    return recode.rule_hits(_recode_input(t), "key", KEY_RULES)


@query(
    "split_positional",
    """
    SELECT p_partkey, split_part(p_name, ' ', 1) AS word_1, nullif(split_part(p_name, ' ', 2), '') AS word_2,
           nullif(split_part(p_name, ' ', 3), '') AS word_3, right(p_name, 1) AS last,
           regexp_matches(p_type, '[A-Z]$') AS capital, contains(p_name, 'ring') AS ring,
           CASE WHEN length(p_size::VARCHAR) >= 2 THEN p_size::VARCHAR ELSE lpad(p_size::VARCHAR, 2, '0') END AS size2
    FROM part
    """,
)
def split_positional(t: Tables) -> DataFrame:
    parts = text.split_columns(t.part.select("p_partkey", "p_name", "p_type", "p_size"), "p_name", " ", 3, "word")
    return parts.select(
        "p_partkey", "word_1", "word_2", "word_3",
        text.last_char(F.col("p_name")).alias("last"),
        text.ends_with_capital(F.col("p_type")).alias("capital"),
        F.col("p_name").contains("ring").alias("ring"),
        text.pad_left(F.col("p_size").cast("string"), 2).alias("size2"),
    )


@query(
    "path_fields",
    r"""
    WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS path FROM pages)
    SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(path, '/([a-z]{2})/', 1) AS lang,
           regexp_extract(path, '[^/]*$', 0) AS last, lower(replace(substr(url, 1, 7), 'http', 'web')) AS head,
           upper(substr(split_part(regexp_extract(url, '^https?://([^/]+)', 1), '.', 1), 1, 1))
             || lower(substr(split_part(regexp_extract(url, '^https?://([^/]+)', 1), '.', 1), 2)) AS site
    FROM p
    """,
)
def path_fields(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", "url").withColumn("path", F.regexp_replace("url", "[?#].*$", ""))
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return pages.select(
        "page_id", host.alias("host"), F.regexp_extract("path", "/([a-z]{2})/", 1).alias("lang"),
        text.last_segment(F.col("path")).alias("last"),
        F.lower(F.replace(text.chars(F.col("url"), 1, 7), F.lit("http"), F.lit("web"))).alias("head"),
        text.title_case(F.substring_index(host, ".", 1)).alias("site"),
    )


@query(
    "date_year_fallback",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS added,
           CAST(year(o_orderdate) AS BIGINT) AS year,
           CASE WHEN o_orderstatus <> 'P' THEN o_orderdate >= DATE '1998-02-03' END AS late
    FROM orders
    """,
)
def date_year_fallback(t: Tables) -> DataFrame:
    us = F.date_format(F.col("o_orderdate").cast("date"), "M/d/yyyy")
    garbled = F.concat(F.lit("on "), us)
    texts = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", garbled).otherwise(us).alias("added"),
        F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("last_action"),
    )
    dated = texts.withColumn("added", text.parse_date(F.col("added"), "M/d/yyyy"))
    return dated.select(
        "o_orderkey", F.col("added").cast("string").alias("added"),
        text.year_or_text(F.col("added"), F.col("last_action")).alias("year"),
        (F.col("added") >= F.lit("1998-02-03").cast("date")).alias("late"),
    )


@query(
    "null_propagating_min",
    """
    WITH l AS (SELECT l_orderkey, CASE WHEN NOT (l_returnflag = 'N' AND l_quantity < 5) THEN CAST(l_shipdate AS DATE) END AS d FROM lineitem),
    g AS (SELECT l_orderkey, CASE WHEN count(*) = count(d) THEN min(d) END AS low FROM l GROUP BY l_orderkey)
    SELECT l_orderkey, CAST(g.low AS VARCHAR) AS first_ship, count(*) AS n_lines,
           CAST(sum(CASE WHEN d = g.low THEN 1 ELSE 0 END) AS BIGINT) AS n_first
    FROM l JOIN g USING (l_orderkey) GROUP BY l_orderkey, g.low
    """,
)
def null_propagating_min(t: Tables) -> DataFrame:
    unknown = (F.col("l_returnflag") == "N") & (F.col("l_quantity") < 5)
    lines = t.lineitem.select("l_orderkey", F.when(~unknown, F.col("l_shipdate").cast("date")).alias("shipped"))
    # Days are counted first, so the lines of the first day need no second look at the rows.
    days = lines.groupBy("l_orderkey", "shipped").agg(F.count(F.lit(1)).alias("n"))
    first = strict(F.min, F.col("shipped"))
    return days.groupBy("l_orderkey").agg(
        first.cast("string").alias("first_ship"),
        F.sum("n").alias("n_lines"),
        F.when(first.isNotNull(), F.min_by("n", "shipped")).otherwise(F.lit(0)).cast("long").alias("n_first"),
    )


@query(
    "cond_in_notin",
    """
    WITH e AS (SELECT nullif(event_type, 'error') AS kind, value FROM events)
    SELECT kind, CASE WHEN kind IS NULL THEN NULL WHEN kind = 'signup' THEN 'S' ELSE 'other' END AS flag,
           CASE WHEN kind = 'signup' THEN 'S' ELSE 'other' END AS fallen, count(*) AS n
    FROM e WHERE kind IS NULL OR kind NOT IN ('click', 'view') GROUP BY ALL
    """,
)
def cond_in_notin(t: Tables) -> DataFrame:
    kinds = t.events.select(F.nullif("event_type", F.lit("error")).alias("kind"))
    kept = kinds.filter(not_in(F.col("kind"), ["click", "view"]))
    signup = F.col("kind") == "signup"
    flags = kept.withColumns(
        {"flag": if_else_na(signup, F.lit("S"), F.lit("other")), "fallen": F.when(signup, "S").otherwise("other")}
    )
    return aggregate.tally(flags, ["kind", "flag", "fallen"])


@query(
    "mean_na_rm",
    """
    WITH e AS (SELECT user_id, 6 - (1 + CAST(floor(value) AS BIGINT) % 5) AS a,
                      CASE WHEN event_type <> 'error' THEN 1 + CAST(floor(value * 10) AS BIGINT) % 5 END AS b FROM events)
    SELECT user_id, round(avg((a + b) / 2.0), 6) AS rr, count(*) AS n FROM e GROUP BY user_id
    """,
)
def mean_na_rm(t: Tables) -> DataFrame:
    a = 1 + F.floor("value") % 5
    b = F.when(F.col("event_type") != "error", 1 + F.floor(F.col("value") * 10) % 5)
    scored = t.events.select("user_id", ((numeric.reverse_scale(a, 5) + b) / 2.0).alias("rr"))
    return scored.groupBy("user_id").agg(rounded(F.avg("rr")).alias("rr"), F.count(F.lit(1)).alias("n"))


_WEIGHTED = """
    WITH l AS (SELECT p_brand, CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 AND l_quantity < {cut} THEN NULL ELSE l_extendedprice END AS x,
                      CASE WHEN l_quantity < {zero} THEN 0 ELSE l_quantity END AS w
               FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT p_brand, round({mean}, 4) AS price FROM l GROUP BY p_brand
"""


def _weighted_price(t: Tables, skip_null: bool, cut: int, zero: int) -> DataFrame:
    """Sums per part first, so the join and its shuffle see one row per part."""
    unknown = (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7) & (F.col("l_quantity") < cut)
    x = F.when(~unknown, F.col("l_extendedprice"))
    w = F.when(F.col("l_quantity") < zero, 0.0).otherwise(F.col("l_quantity"))
    by_part = t.lineitem.groupBy("l_partkey").agg(*weighted_sums(x, w, skip_null))
    brands = joins.left_join(by_part, t.part.select("p_partkey", "p_brand"), [("l_partkey", "p_partkey")], **PLAIN)
    return brands.groupBy("p_brand").agg(rounded(weighted_mean_of_sums(), 4).alias("price"))


@query(
    "weighted_mean_na_rm",
    _WEIGHTED.format(cut=20, zero=3, mean="sum(x * w) / nullif(sum(CASE WHEN x IS NOT NULL THEN w END), 0)"),
)
def weighted_mean_na_rm(t: Tables) -> DataFrame:
    return _weighted_price(t, True, 20, 3)


@query(
    "weighted_mean_strict",
    _WEIGHTED.format(
        cut=4, zero=4, mean="CASE WHEN count(*) FILTER (x IS NULL AND w <> 0) = 0 THEN sum(x * w) / nullif(sum(w), 0) END"
    ).replace("l_quantity < 4 THEN NULL", "(l_quantity < 4 OR (l_quantity < 5 AND p_brand < 'Brand#15')) THEN NULL"),
)
def weighted_mean_strict(t: Tables) -> DataFrame:
    """Sums per part under both rules; the brand, known after the join, picks one of them."""
    w = F.when(F.col("l_quantity") < 4, 0.0).otherwise(F.col("l_quantity"))

    def sums(limit: int, prefix: str) -> list[Column]:
        unknown = (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7) & (F.col("l_quantity") < limit)
        return weighted_sums(F.when(~unknown, F.col("l_extendedprice")), w, skip_null=False, prefix=prefix)

    by_part = t.lineitem.groupBy("l_partkey").agg(*sums(4, "__"), *sums(5, "__early_"))
    brands = joins.left_join(by_part, t.part.select("p_partkey", "p_brand"), [("l_partkey", "p_partkey")], **PLAIN)
    early = F.col("p_brand") < "Brand#15"
    picked = [F.when(early, F.col(f"__early_{c}")).otherwise(F.col(f"__{c}")).alias(f"__{c}") for c in ("wx", "w", "bad")]
    return brands.select("p_brand", *picked).groupBy("p_brand").agg(rounded(weighted_mean_of_sums(), 4).alias("price"))


@query(
    "two_party_share",
    """
    WITH s AS (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS v_click,
                      sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS v_view, count(*) AS n
               FROM events GROUP BY user_id)
    SELECT user_id, n, round(v_click / nullif(v_click + v_view, 0), 6) AS share,
           round(1 - v_click / nullif(v_click + v_view, 0), 6) AS other FROM s
    """,
)
def two_party_share(t: Tables) -> DataFrame:
    parties = {f"v_{p}": F.when(F.col("event_type") == p, F.col("value")).otherwise(0.0) for p in ("click", "view")}
    sums = t.events.select("user_id", *[c.alias(n) for n, c in parties.items()]).groupBy("user_id").agg(
        *aggregate.sum_each(list(parties)), F.count(F.lit(1)).alias("n")
    )
    share = aggregate.share_of("v_click", numeric.by_prefix(sums, "v_"))
    out = sums.withColumn("share", share)
    return out.select("user_id", "n", rounded("share").alias("share"), rounded(1 - F.col("share")).alias("other"))


YEARS = list(range(1997, 2002))


@query(
    "group_share_wide",
    """
    WITH s AS (SELECT c_mktsegment, o_orderstatus, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS votes
               FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL),
    f AS (SELECT *, votes / sum(votes) OVER (PARTITION BY c_mktsegment, y) AS share FROM s)
    SELECT upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS state,
           """
    + ",\n".join(f"round(max(CASE WHEN y = {y} THEN share END), 6) AS share_{y}" for y in YEARS)
    + """
    FROM f WHERE o_orderstatus = 'F' AND y > 1996 GROUP BY c_mktsegment
    """,
)
def group_share_wide(t: Tables) -> DataFrame:
    by_customer = (
        t.orders.filter(F.col("o_orderstatus").isin("F", "O"))
        .groupBy("o_custkey", "o_orderstatus", F.year(F.col("o_orderdate").cast("date")).alias("year"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("votes"))
    )
    joined = joins.left_join(by_customer, t.customer.select("c_custkey", "c_mktsegment"), [("o_custkey", "c_custkey")], **PLAIN)
    votes = joined.groupBy("c_mktsegment", "o_orderstatus", "year").agg(F.sum("votes").alias("votes"))
    votes = votes.withColumn("votes", F.col("votes").cast("double"))
    shares = groups.with_share(votes, ["c_mktsegment", "year"], "votes", small_groups=True)
    kept = shares.filter((F.col("o_orderstatus") == "F") & (F.col("year") > 1996))
    named = kept.select(text.title_case(F.col("c_mktsegment")).alias("state"), "year", rounded("share").alias("share"))
    return reshape.widen(named, ["state"], "year", YEARS, ["share"], name=lambda v, y: f"{v}_{y}")


@query(
    "conditional_ratio",
    """
    SELECT year(l_shipdate)::VARCHAR AS ship_year,
           round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS share
    FROM lineitem GROUP BY 1
    """,
)
def conditional_ratio(t: Tables) -> DataFrame:
    key = F.year(F.col("l_shipdate").cast("date")).cast("string").alias("ship_year")
    share = aggregate.conditional_ratio(F.col("l_extendedprice"), F.col("l_returnflag") == "R")
    return t.lineitem.groupBy(key).agg(rounded(share).alias("share"))


@query(
    "two_grain_stack",
    """
    SELECT l_suppkey AS "GEOID", 'SD' AS chamber, CAST(sum(l_quantity) AS BIGINT) AS qty, count(*) AS n FROM lineitem GROUP BY 1
    UNION ALL
    SELECT l_partkey, 'HD', CAST(sum(l_quantity) AS BIGINT), count(*) FROM lineitem GROUP BY 1
    """,
)
def two_grain_stack(t: Tables) -> DataFrame:
    measures = [F.sum("l_quantity").cast("long").alias("qty"), F.count(F.lit(1)).alias("n")]
    return aggregate.stack_grains(t.lineitem, {"SD": "l_suppkey", "HD": "l_partkey"}, measures)


@query(
    "inverse_group_weight",
    """
    SELECT c_custkey, c_nationkey, round(1.0 / count(*) OVER (PARTITION BY c_nationkey), 9) AS w,
           row_number() OVER (ORDER BY c_custkey) AS id FROM customer
    """,
)
def inverse_group_weight(t: Tables) -> DataFrame:
    weighted = groups.with_inverse_size(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"])
    return groups.with_row_number(weighted, "c_custkey", name="id").select(
        "c_custkey", "c_nationkey", rounded("w", 9).alias("w"), "id"
    )


def _status_counts(t: Tables) -> DataFrame:
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return t.orders.groupBy("o_custkey", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(urgent).alias("n_pass")
    )


@query(
    "mixed_group_relabel",
    """
    WITH g AS (SELECT l_orderkey, l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS n_pass FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, CASE WHEN count(*) > 1 THEN 'M' ELSE max(l_returnflag) END AS party,
           CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_pass) AS BIGINT) AS n_pass FROM g GROUP BY l_orderkey
    """,
)
def mixed_group_relabel(t: Tables) -> DataFrame:
    """Orders are seats, the return flags of their lines parties."""
    by_party = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("party")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("n_pass")
    )
    return groups.relabel_mixed(by_party, ["l_orderkey"], "party", "M", ["n", "n_pass"])


STATUSES = ["F", "O", "P"]


@query(
    "pivot_multi_value",
    "SELECT o_custkey, "
    + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS n_{s}" for s in STATUSES)
    + ", "
    + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}' AND o_orderpriority = '1-URGENT') AS n_pass_{s}" for s in STATUSES)
    + " FROM orders GROUP BY o_custkey",
)
def pivot_multi_value(t: Tables) -> DataFrame:
    return reshape.widen(_status_counts(t), ["o_custkey"], "o_orderstatus", STATUSES, ["n", "n_pass"], fill=0)


@query(
    "unpivot_parse_wide",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT o_custkey, '{s}' AS impact, count(*) FILTER (o_orderstatus = '{s}') AS n_intro,"
        f" count(*) FILTER (o_orderstatus = '{s}' AND o_orderpriority = '1-URGENT') AS n_pass,"
        f" count(*) FILTER (o_orderstatus = '{s}') > 0 AS sp_intro,"
        f" count(*) FILTER (o_orderstatus = '{s}' AND o_orderpriority = '1-URGENT') > 0 AS sp_pass"
        " FROM orders GROUP BY o_custkey"
        for s in STATUSES
    )
    + ")",
)
def unpivot_parse_wide(t: Tables) -> DataFrame:
    wide = pivot_multi_value(t)
    long = reshape.lengthen(wide, ["o_custkey"], numeric.by_prefix(wide, "n_"), "impact", "n")
    parsed = long.withColumns(
        {
            "sp": F.col("n") > 0,
            "stage": F.when(F.col("impact").contains("pass"), "pass").otherwise("intro"),
            "impact": text.last_char(F.col("impact")),
        }
    )
    return reshape.widen(parsed, ["o_custkey", "impact"], "stage", ["intro", "pass"], ["n", "sp"])


_BLOCKS = {"house": "F", "senate": "O"}
_COLUMNS = {"U": "1-URGENT", "H": "2-HIGH"}


def _crosstab_sql() -> str:
    cells = []
    for b, s in _BLOCKS.items():
        for c, p in _COLUMNS.items():
            here = f"o_orderstatus = '{s}' AND o_orderpriority = '{p}'"
            cells.append(
                f"CASE WHEN count(*) FILTER (o_orderstatus = '{s}') = 0 THEN 'Voice Vote' "
                f"WHEN count(*) FILTER ({here}) > 0 THEN count(*) FILTER ({here} AND o_totalprice > 200000)::VARCHAR "
                f"|| ' / ' || count(*) FILTER ({here})::VARCHAR END AS {c}_{b}"
            )
    return (
        "WITH g AS (SELECT o_custkey, " + ", ".join(cells) + " FROM orders GROUP BY o_custkey) "
        "SELECT c_custkey, n_name, g.* EXCLUDE (o_custkey) FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey "
        "LEFT JOIN g ON o_custkey = c_custkey"
    )


@query("crosstab_text", _crosstab_sql())
def crosstab_text(t: Tables) -> DataFrame:
    cells = reshape.crosstab_cells(
        t.orders, ["o_custkey"],
        {b: F.col("o_orderstatus") == s for b, s in _BLOCKS.items()},
        {c: F.col("o_orderpriority") == p for c, p in _COLUMNS.items()},
        F.col("o_totalprice") > 200000, empty_block="Voice Vote",
    )
    named = joins.left_join(
        t.customer.select("c_custkey", "c_nationkey"), t.nation.select("n_nationkey", "n_name"),
        [("c_nationkey", "n_nationkey")],
    )
    return joins.left_join(named, cells, [("c_custkey", "o_custkey")], **PLAIN).drop("c_nationkey")


@query(
    "context_join",
    """
    WITH s AS (SELECT c_nationkey, avg(c_acctbal) AS state_bal, count(*) AS state_n,
                      count(*) FILTER (c_mktsegment = 'BUILDING') / count(*) AS share FROM customer GROUP BY c_nationkey),
    r AS (SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, n_name, r_name, state_n, round(state_bal, 4) AS state_bal, share > 0.18 AND share < 0.22 AS competitive,
           (CASE WHEN c_acctbal > 0 THEN r_name = 'ASIA' END) OR n_name = 'NATION_7' AS r
    FROM customer JOIN s USING (c_nationkey) JOIN r ON c_nationkey = n_nationkey
    """,
)
def context_join(t: Tables) -> DataFrame:
    state = t.customer.groupBy("c_nationkey").agg(
        F.avg("c_acctbal").alias("state_bal"), F.count(F.lit(1)).alias("state_n"),
        aggregate.conditional_ratio(F.lit(1), F.col("c_mktsegment") == "BUILDING").alias("share"),
    )
    nations = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    regions = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    context = joins.left_join(nations, regions, ["n_regionkey"])
    out = joins.join_all(t.customer, [state, context], ["c_nationkey"])
    control = F.when(F.col("c_acctbal") > 0, F.col("r_name"))
    return out.select(
        "c_custkey", "n_name", "r_name", "state_n", rounded("state_bal", 4).alias("state_bal"),
        numeric.strictly_between(F.col("share"), 0.18, 0.22).alias("competitive"),
        ((control == "ASIA") | (F.col("n_name") == "NATION_7")).alias("r"),
    )


@query(
    "complete_cases",
    """
    WITH f AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS spent, count(*) AS n FROM orders
               WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' GROUP BY o_custkey),
    u AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' GROUP BY o_custkey)
    SELECT c_custkey, CAST(spent AS DOUBLE) AS spent, n, top FROM customer
    JOIN f ON f.o_custkey = c_custkey JOIN u ON u.o_custkey = c_custkey
    """,
)
def complete_cases(t: Tables) -> DataFrame:
    high = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "2-HIGH")
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "P")
    price = F.col("o_totalprice")
    facts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.when(high, price.cast("decimal(18,2)"))).cast("double").alias("spent"),
        F.count_if(high).alias("n"),
        F.max(F.when(urgent, price)).alias("top"),
    )
    panel = joins.left_join(t.customer.select("c_custkey"), facts, ["c_custkey"], **PLAIN)
    return panel.dropna(subset=["spent", "n", "top"])


@query(
    "category_rank",
    """
    WITH g AS (SELECT event_type, count(*) AS intro, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS passed FROM events GROUP BY 1)
    SELECT CASE event_type WHEN 'click' THEN 'Mouse' WHEN 'error' THEN 'Other' ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS grp,
           intro, CAST(passed AS BIGINT) AS passed, CASE WHEN event_type = 'error' THEN -999 ELSE intro END AS intro2,
           (SELECT max(intro) FROM g) + 5 AS upper_bound,
           CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS level
    FROM g
    """,
)
def category_rank(t: Tables) -> DataFrame:
    counts = t.events.groupBy("event_type").agg(
        *aggregate.total_and_subset(F.lit(1), F.col("value") > 50, "intro", "passed")
    )
    kind = F.col("event_type")
    label = F.when(kind == "click", "Mouse").when(kind == "error", "Other").otherwise(text.title_case(kind))
    named = counts.withColumn("grp", label).withColumn("level", aggregate.level_rank(kind, ["signup", "click", "purchase"]))
    # One row per category, so a window over all of them is small.
    named = named.withColumn("upper_bound", F.max("intro").over(Window.partitionBy()) + 5)
    named = named.withColumn("intro2", F.when(F.col("grp") == "Other", F.lit(-999)).otherwise(F.col("intro")))
    ranked = aggregate.ranked_categories(named, "grp", "intro2", "Other")
    return ranked.select("grp", "intro", "passed", "intro2", "upper_bound", "level")


@query(
    "scale_columns",
    """
    WITH y AS (SELECT o_custkey, sum(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice ELSE 0 END) AS old,
                      sum(CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice ELSE 0 END) AS new,
                      count(*) FILTER (o_orderstatus = 'F') / count(*) AS share FROM orders GROUP BY 1)
    SELECT o_custkey, round(new / nullif(old, 0) - 1, 6) AS change, round((new - old) / 10000, 6) AS change_abs,
           round(CASE WHEN new > 0 THEN ln(new) END, 6) AS log_new, round(share * 100, 6) AS share,
           format('{:,}', CAST(floor(new) AS BIGINT)) AS new_text
    FROM y
    """,
)
def scale_columns(t: Tables) -> DataFrame:
    year = F.year(F.col("o_orderdate").cast("date"))
    price = F.col("o_totalprice")
    # The text cuts a sum of doubles to its whole part, so the last digit counts: rows add up as they stand in the files.
    orders = t.orders.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    priced = aggregate.sums_in_order(orders, ["o_custkey"], ["file", "at"], {
        "old": F.when(year == 1996, price).otherwise(0.0), "new": F.when(year == 2000, price).otherwise(0.0),
    })
    sums = priced.groupBy("o_custkey").agg(
        F.max("old").alias("old"), F.max("new").alias("new"),
        aggregate.conditional_ratio(F.lit(1), F.col("o_orderstatus") == "F").alias("share"),
    )
    scaled = numeric.across(sums, ["share"], lambda c: c * 100)
    new, old = F.col("new"), F.col("old")
    return scaled.select(
        "o_custkey", rounded(numeric.relative_change(new, old)).alias("change"),
        rounded((new - old) / 10000, 6).alias("change_abs"), rounded(F.ln(new)).alias("log_new"),
        rounded("share").alias("share"), text.thousands(F.floor(new)).alias("new_text"),
    )


@query(
    "dim_chain",
    """
    SELECT n_name, r_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price, count(*) AS n
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT DISTINCT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
      ON c_nationkey = n_nationkey
    GROUP BY ALL
    """,
)
def dim_chain(t: Tables) -> DataFrame:
    """Each hop aggregates first, so every join and shuffle carries one row per key."""
    price = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price")
    by_order = t.lineitem.groupBy("l_orderkey").agg(price, F.count(F.lit(1)).alias("n"))
    orders = t.orders.select("o_orderkey", "o_custkey")
    by_customer = (
        joins.left_join(by_order, orders, [("l_orderkey", "o_orderkey")], **PLAIN)
        .groupBy("o_custkey").agg(*aggregate.sum_each(["price", "n"]))
    )
    customers = t.customer.select("c_custkey", "c_nationkey")
    by_nation = (
        joins.left_join(by_customer, customers, [("o_custkey", "c_custkey")], **PLAIN)
        .groupBy("c_nationkey").agg(*aggregate.sum_each(["price", "n"]))
    )
    region = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    lookup = dimension(joins.left_join(t.nation, region, ["n_regionkey"]), ["n_nationkey", "n_name", "r_name"])
    named = joins.left_join(by_nation, lookup, [("c_nationkey", "n_nationkey")], expect="one")
    return named.select("n_name", "r_name", F.col("price").cast("double").alias("price"), "n")


@query(
    "sponsor_party_counts",
    """
    WITH s AS (SELECT conv_id, turn + 1 AS position, CASE WHEN role = 'system' AND turn = 0 THEN 'user' ELSE role END AS party FROM conversations)
    SELECT 'all' AS sponsors, CASE party WHEN 'user' THEN 'Republican' WHEN 'assistant' THEN 'Democrat' END AS party, count(*) AS n,
           format('{:,}', count(*)) AS label FROM s GROUP BY party
    UNION ALL
    SELECT 'primary', CASE party WHEN 'user' THEN 'Republican' WHEN 'assistant' THEN 'Democrat' END, count(*), format('{:,}', count(*))
    FROM s WHERE position = 1 GROUP BY party
    """,
)
def sponsor_party_counts(t: Tables) -> DataFrame:
    rows = t.conversations.select((F.col("turn") + 1).alias("position"), F.col("role").alias("party"))
    rows = recode.recode(rows, "party", [recode.Assign("party = 'system' and position = 1", "user")])
    party = F.col("party")
    label = F.when(party == "user", "Republican").when(party == "assistant", "Democrat")
    # Both tallies in one pass.
    counts = rows.groupBy("party").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("position") == 1).alias("primary"))
    long = reshape.lengthen(counts, ["party"], ["all", "primary"], "sponsors", "n").filter("n > 0")
    return long.select("sponsors", label.alias("party"), "n", text.thousands(F.col("n")).alias("label"))
