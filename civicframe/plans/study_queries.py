"""Study compositions over the test tables.

Orders stand for bills and roll calls, line items for sponsors and votes,
suppliers for people; the lineage file is a dump that order numbers belong to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.local import small_frame
from . import study
from .registry import Tables, query, rounded

PARTIES = ["R", "D", "I", "L"]


def _dump(key: str) -> Column:
    return F.concat(F.lit("dump_"), (F.col(key) % 3).cast("string"))


DUMPS = ("dump_0", "dump_1", "dump_2")


def _people(t: Tables, dumps: Sequence[str]) -> DataFrame:
    """Every dump repeats the people, as such dumps do."""
    party = F.get(F.array(*[F.lit(p) for p in PARTIES]), F.col("s_nationkey") % 4)
    files = F.explode(F.array(*[F.lit(d) for d in dumps]))
    return t.supplier.select(
        F.col("s_suppkey").alias("people_id"), F.col("s_name").alias("name"), party.alias("party"),
        F.concat_ws("-", F.lit("SD"), F.col("s_nationkey").cast("string")).alias("district"), files.alias("file"),
    )


@query(
    "sponsor_chain",
    """
    WITH p AS (SELECT s_suppkey, ['R', 'D', 'I', 'L'][s_nationkey % 4 + 1] AS party, 'SD-' || s_nationkey AS district FROM supplier)
    SELECT party, district, count(*) AS n, count(*) FILTER (l_linenumber = 1) AS n_primary
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN p ON s_suppkey = l_suppkey
    GROUP BY ALL
    """,
)
def sponsor_chain(t: Tables) -> DataFrame:
    bills = t.orders.select(F.col("o_orderkey").alias("bill_id"), _dump("o_orderkey").alias("file"))
    sponsors = t.lineitem.select(
        F.col("l_orderkey").alias("bill_id"), F.col("l_suppkey").alias("people_id"), F.col("l_linenumber").alias("position"),
        _dump("l_orderkey").alias("file"),
    )
    rows = study.sponsor_rows(bills, sponsors, _people(t, DUMPS), ["party", "district", "position"])
    return rows.groupBy("party", "district").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("position") == 1).alias("n_primary")
    )


def _votes_sql() -> str:
    cells = []
    for chamber in ("house", "senate"):
        for p in PARTIES:
            here = f"chamber = '{chamber}' AND party = '{p}'"
            cells.append(
                f"CASE WHEN count(*) FILTER (chamber = '{chamber}') = 0 THEN 'Voice Vote' WHEN count(*) FILTER ({here}) > 0 "
                f"THEN count(*) FILTER ({here} AND vote = 'Yea')::VARCHAR || ' / ' || count(*) FILTER ({here})::VARCHAR END AS {p}_{chamber}"
            )
    return f"""
    WITH h AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'F') AS house, max(o_orderkey) FILTER (o_orderstatus = 'O') AS senate
               FROM orders GROUP BY o_custkey),
    calls AS (SELECT o_custkey, 'house' AS chamber, house AS rc FROM h UNION ALL SELECT o_custkey, 'senate', senate FROM h),
    v AS (SELECT o_custkey, chamber, ['R', 'D', 'I', 'L'][s_nationkey % 4 + 1] AS party, CASE l_returnflag WHEN 'A' THEN 'Yea' ELSE 'Nay' END AS vote
          FROM calls JOIN lineitem ON l_orderkey = rc JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'R')
    SELECT c_name AS "Bill", {', '.join(cells)} FROM customer LEFT JOIN v ON o_custkey = c_custkey GROUP BY c_name
    """


@query("vote_crosstab", _votes_sql())
def vote_crosstab(t: Tables) -> DataFrame:
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    links = t.orders.groupBy(F.col("o_custkey").alias("bill_id")).agg(
        F.min(F.when(status == "F", key)).alias("house"), F.max(F.when(status == "O", key)).alias("senate")
    )
    bills = t.customer.select(F.col("c_name").alias("bill"), F.col("c_custkey").alias("bill_id"), F.lit("all").alias("file"))
    link = {c: F.concat(F.lit("https://example.org/rollcall/"), F.col(c).cast("string")) for c in ("house", "senate")}
    urls = bills.join(links, "bill_id").select("bill", *[u.alias(f"{c.title()} URL") for c, u in link.items()])
    calls = t.orders.select(
        key.alias("roll_call_id"), F.col("o_custkey").alias("bill_id"), F.lit("all").alias("file"), F.col("o_orderdate").alias("date")
    )
    vote = F.when(F.col("l_returnflag") == "A", "Yea").when(F.col("l_returnflag") == "N", "Nay").otherwise("Absent")
    votes = t.lineitem.select(
        F.col("l_orderkey").alias("roll_call_id"), F.col("l_suppkey").alias("people_id"), vote.alias("vote_desc"), F.lit("all").alias("file")
    )
    return study.vote_crosstab(bills, urls, calls, votes, _people(t, ["all"]))


@query(
    "provision_cube",
    """
    SELECT "group", sum(n)::BIGINT AS intro, sum(CASE WHEN pass THEN n ELSE 0 END)::BIGINT AS passed FROM (
      SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'Other' ELSE 'Early Voting' END AS "group", o_orderstatus = 'F' AS pass, count(*) AS n
      FROM orders WHERE o_totalprice > 100000 GROUP BY ALL) GROUP BY "group"
    """,
)
def provision_cube(t: Tables) -> DataFrame:
    """Counts by (state, pass, group), then the category table from that small cube."""
    rows = t.orders.select(
        F.year(F.col("o_orderdate").cast("date")).alias("state"), (F.col("o_orderstatus") == "F").alias("pass"),
        F.when(F.col("o_orderpriority") == "5-LOW", "other").otherwise("early").alias("group"),
        F.when(F.col("o_totalprice") > 100000, "R").otherwise("N").alias("impact"),
    )
    return study.category_table(study.provision_counts(rows)).select("group", "intro", "passed")


@query(
    "district_seats",
    """
    WITH c AS (SELECT s_nationkey, ['R', 'D', 'I', 'L'][l_linenumber % 4 + 1] AS party, CASE l_returnflag WHEN 'A' THEN 'E' ELSE l_returnflag END AS impact, l_linestatus = 'F' AS pass
               FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
    SELECT 'SD' AS chamber, CASE WHEN s_nationkey = 7 THEN '48999' ELSE '48' || lpad(s_nationkey::VARCHAR, 3, '0') END AS "GEOID", impact, n_intro, n_pass, n_intro > 0 AS sp_intro, n_pass > 0 AS sp_pass FROM (
      SELECT s_nationkey, i.impact, count(*) FILTER (c.impact = i.impact) AS n_intro, count(*) FILTER (c.impact = i.impact AND pass) AS n_pass
      FROM c CROSS JOIN (VALUES ('R'), ('N'), ('E')) AS i(impact) GROUP BY s_nationkey, i.impact)
    """,
)
def district_seats(t: Tables) -> DataFrame:
    """Sponsor rows to one row per seat and impact; parties of a seat collapse to one label."""
    seat = F.concat(F.lit("SD-"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"))
    sums = t.lineitem.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = sums.select(
        F.lit("Texas").alias("state"), F.lit("b").alias("bill"), seat.alias("district"), F.lit(2).alias("position"),
        F.get(F.array(*[F.lit(p) for p in PARTIES]), F.col("l_linenumber") % 4).alias("party"),
        F.when(F.col("l_returnflag") == "A", "E").otherwise(F.col("l_returnflag")).alias("impact"),
        (F.col("l_linestatus") == "F").alias("pass"),
    )
    overrides = small_frame(t.spark, [("Texas", "SD-007", "48999")], "state string, district string, GEOID string")
    states = t.region.select(F.lit("Texas").alias("state_name"), F.lit("48").alias("state_code"))
    seats = study.district_sponsors(rows, overrides, states, ["state", "district"])
    named = seats.select("chamber", F.col("district").alias("GEOID"), *[c for c in seats.columns if c.startswith("n_")])
    return study.by_impact(named, ["chamber", "GEOID"])


@query(
    "canonical_bills",
    """
    WITH b AS (SELECT o_orderkey AS bill_id, o_custkey % 40 AS session_id, ['FL', 'NY', 'RI', 'TX'][o_custkey % 4 + 1] AS state,
                      'H' || lpad((o_orderkey % 500)::VARCHAR, 4, '0') AS number, o_orderkey % 11 = 0 AS bad, o_orderkey % 500 AS plain,
                      year(o_orderdate)::VARCHAR AS year, 'dump_' || (o_orderkey % 3) AS file FROM orders),
    s AS (SELECT range AS session_id, CASE range % 3 WHEN 0 THEN '' WHEN 1 THEN '(S)' ELSE '(S-2)' END AS session FROM range(39)),
    k AS (SELECT bill_id, b.session_id, file,
                 state || ' ' || CASE WHEN bad AND state <> 'TX' THEN number || 'A' WHEN state IN ('FL', 'NY') THEN 'HB' || plain WHEN state = 'RI' THEN 'H' || plain
                                      ELSE number || CASE WHEN bad THEN 'A' ELSE '' END END AS bill_merge,
                 trim(year || ' ' || coalesce(session, 'NA')) AS year
          FROM b LEFT JOIN s ON s.session_id = b.session_id)
    SELECT bill_merge, year, bill_id FROM k QUALIFY row_number() OVER (PARTITION BY bill_merge, year ORDER BY session_id, file, bill_id) = 1
    """,
)
def canonical_bills(t: Tables) -> DataFrame:
    """Orders as bills of four states; every eleventh has a number that cannot be read, one session is unknown."""
    key = F.col("o_orderkey")
    state = F.get(F.array(*[F.lit(x) for x in ("FL", "NY", "RI", "TX")]), (F.col("o_custkey") % 4).cast("int"))
    number = F.concat(F.lit("H"), F.lpad((key % 500).cast("string"), 4, "0"), F.when(key % 11 == 0, "A").otherwise(""))
    day = F.col("o_orderdate").cast("date")
    bills = t.orders.select(
        key.alias("bill_id"), (F.col("o_custkey") % 40).alias("session_id"), number.alias("bill_number"),
        F.when(key % 5 != 0, day).alias("status_date"), F.date_format(day, "yyyy-MM-dd").alias("last_action_date"),
        F.concat(F.lit("https://legiscan.com/"), state, F.lit("/bill")).alias("url"), _dump("o_orderkey").alias("file"),
    )
    kinds = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "(S)").otherwise("(S-2)")
    sessions = t.spark.range(39).select(F.col("id").alias("session_id"), kinds.alias("session"))
    return study.canonical_bills(bills, sessions).select("bill_merge", "year", "bill_id")


@query(
    "clean_provisions",
    """
    WITH l AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'N' WHEN 2 THEN 'E' END AS impact,
                      CASE l_returnflag WHEN 'A' THEN 'voter id' WHEN 'N' THEN 'early' END AS grp FROM lineitem)
    SELECT 'S' || (l_orderkey % 3) AS state, grp AS "group", impact, l_linestatus = 'F' AS pass, count(*) AS n, count(DISTINCT l_orderkey) AS bills
    FROM l JOIN orders ON o_orderkey = l_orderkey AND year(o_orderdate) = year(l_shipdate)
    WHERE impact IS NOT NULL AND grp IS NOT NULL GROUP BY ALL
    """,
)
def clean_provisions(t: Tables) -> DataFrame:
    """Line items as provisions of orders; a provision finds its bill if both fall in the same year."""
    state = F.concat(F.lit("S"), (F.col("l_orderkey") % 3).cast("string"))
    words = F.array(*[F.lit(x) for x in ("Restrictive", "neutral", "Expansive", "unknown")])
    key = lambda c: F.concat(F.lit("TX "), F.col(c).cast("string"))
    day = F.col("l_shipdate").cast("date")
    provisions = t.lineitem.select(
        state.alias("state"), F.concat(F.lit("B"), F.col("l_orderkey").cast("string")).alias("bill"), F.col("l_returnflag").alias("subject"),
        F.get(words, F.col("l_linenumber") % 4).alias("impact"), F.year(day).cast("string").alias("year"), key("l_orderkey").alias("bill_merge"),
        day.alias("date_added"), (F.col("l_linestatus") == "F").alias("pass"),
    )
    bills = t.orders.select(
        F.col("o_orderkey").alias("bill_id"), F.lit("t").alias("title"), _dump("o_orderkey").alias("file"), key("o_orderkey").alias("bill_merge"),
        F.year(F.col("o_orderdate").cast("date")).cast("string").alias("year"),
    )
    groupings = small_frame(t.spark, [("a", "voter id"), ("n", "early")], "subject string, group string")
    rows = study.clean_provisions(provisions, bills, groupings)
    return rows.groupBy("state", "group", "impact", "pass").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bill_id").alias("bills"))


@query(
    "state_panel_study",
    """
    WITH c AS (SELECT c_nationkey AS k, count(*) AS people, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS white FROM customer GROUP BY 1),
    s AS (SELECT s_nationkey AS k, avg(CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS before FROM supplier GROUP BY 1),
    p AS (SELECT c_nationkey AS k, count(*) FILTER (l_returnflag <> 'N') AS intro, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') AS passed
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    v AS (SELECT c_nationkey AS k, y, CASE WHEN d > 0 THEN d / (d + r) END AS share FROM (
            SELECT c_nationkey, CASE WHEN year(o_orderdate) % 2 = 0 THEN 2016 ELSE 2020 END AS y, count(*) FILTER (o_orderstatus = 'F') AS d,
                   count(*) FILTER (o_orderstatus = 'O') AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)),
    w AS (SELECT k, max(share) FILTER (y = 2016) AS d16, max(share) FILTER (y = 2020) AS d20 FROM v GROUP BY k)
    SELECT n_name AS "NAME", coalesce(intro, 0) AS intro, coalesce(passed, 0) AS passed, round(white * 100, 6) AS nh_white, round((white - before), 6) AS change_white_abs,
           n_nationkey / 10 AS "FinalCOVI", round(d16, 6) AS dem_share_2016, round(d20, 6) AS dem_share_2020, round((d20 - d16) * 100, 6) AS change_dem,
           round(ln(people), 6) AS population, CASE n_regionkey WHEN 0 THEN 'Republican' WHEN 1 THEN NULL ELSE 'Other' END AS r,
           CASE WHEN d20 > 0.45 AND d20 < 0.55 THEN 'Competitive' WHEN d20 IS NOT NULL THEN 'ANC' END AS competitive
    FROM nation JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey LEFT JOIN p ON p.k = n_nationkey LEFT JOIN w ON w.k = n_nationkey
    """,
)
def state_panel_study(t: Tables) -> DataFrame:
    """Nations as states: provisions, people, votes and control meet in one row per state."""
    code = F.col("n_nationkey").cast("string")
    nations = t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("NAME"), "n_regionkey")
    people = t.customer.groupBy(F.col("c_nationkey").alias("key")).agg(
        F.count(F.lit(1)).cast("double").alias("population"), F.avg((F.col("c_acctbal") > 0).cast("double")).alias("nh_white"),
        F.avg("c_acctbal").alias("median_income"),
    )
    demographics = nations.join(people, "key").select(
        "NAME", F.col("key").cast("string").alias("GEOID"), "population", "nh_white", "median_income", F.lit(0.5).alias("some_college")
    )
    earlier = t.supplier.groupBy(F.col("s_nationkey").cast("string").alias("GEOID")).agg(F.avg((F.col("s_acctbal") > 0).cast("double")).alias("nh_white"))
    index = t.nation.select(F.concat(F.lit("S"), code).alias("state"), F.lit(2020).alias("year"), (F.col("n_nationkey") / 10).alias("FinalCOVI"))
    states = t.nation.select(F.concat(F.lit("S"), code).alias("state"), F.col("n_name").alias("state_name"), code.alias("state_code"))
    of_order = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    party = F.when(F.col("o_orderstatus") == "F", "DEMOCRAT").when(F.col("o_orderstatus") == "O", "REPUBLICAN").otherwise("OTHER")
    year = F.when(F.year(F.col("o_orderdate").cast("date")) % 2 == 0, 2016).otherwise(2020)
    votes = of_order.groupBy(F.col("n_name").alias("state"), party.alias("party_simplified"), year.alias("year")).agg(F.count(F.lit(1)).alias("candidatevotes"))
    control = t.nation.select(F.col("n_name").alias("NAME"), F.when(F.col("n_regionkey") == 0, "Rep").when(F.col("n_regionkey") != 1, "Dem").alias("control"))
    rows = t.lineitem.join(of_order.select("o_orderkey", "n_name"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("n_name").alias("state"), (F.col("l_linestatus") == "F").alias("pass"), F.col("l_returnflag").alias("group"),
        F.when(F.col("l_returnflag") == "N", "N").otherwise("R").alias("impact"),
    )
    panel = study.state_panel(study.provision_counts(rows), demographics, earlier, index, states, votes, control)
    numbers = ["nh_white", "change_white_abs", "dem_share_2016", "dem_share_2020", "change_dem", "population"]
    return panel.select("NAME", "intro", "passed", "FinalCOVI", "r", "competitive", *[rounded(c).alias(c) for c in numbers])


@query(
    "district_panel_study",
    """
    WITH cu AS (SELECT c_custkey AS id, c_nationkey AS k, lpad(c_nationkey::VARCHAR, 2, '0') || lpad((c_custkey % 12)::VARCHAR, 3, '0') AS geo,
                       CASE WHEN c_custkey % 2 = 0 THEN 'HD' ELSE 'SD' END AS chamber, c_custkey % 12 AS seat, c_acctbal AS bal FROM customer),
    demo AS (SELECT geo, chamber, k, seat, count(*) AS people, avg((bal > 0)::INT) AS white, avg(bal) AS income, avg(id % 90) AS age, avg((id % 3 = 0)::INT) AS college
             FROM cu GROUP BY geo, chamber, k, seat),
    early AS (SELECT lpad(s_nationkey::VARCHAR, 2, '0') || lpad((s_suppkey % 12)::VARCHAR, 3, '0') AS geo, CASE WHEN s_suppkey % 2 = 0 THEN 'HD' ELSE 'SD' END AS chamber,
                     avg((s_acctbal > 0)::INT) AS before FROM supplier GROUP BY 1, 2),
    around AS (SELECT k, avg((bal > 0)::INT) AS state_white FROM cu GROUP BY k),
    o AS (SELECT orders.*, cu.* FROM orders JOIN cu ON o_custkey = id),
    facts AS (SELECT geo, chamber, impact, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS passed
              FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'E' WHEN 'R' THEN 'R' ELSE 'N' END AS impact FROM lineitem) JOIN o ON l_orderkey = o_orderkey
              WHERE l_quantity > 40 GROUP BY ALL),
    shares AS (SELECT geo, chamber, count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus IN ('F', 'O')), 0) AS share
               FROM o WHERE seat % 4 <> 0 GROUP BY ALL),
    fallback AS (SELECT geo, chamber, avg((o_orderkey % 2)::INT) AS share FROM o WHERE seat % 3 <> 1 GROUP BY ALL),
    share AS (SELECT geo, chamber, share FROM shares WHERE share IS NOT NULL
              UNION ALL SELECT geo, chamber, share FROM fallback ANTI JOIN (SELECT geo, chamber FROM shares WHERE share IS NOT NULL) USING (geo, chamber)),
    d20 AS (SELECT k, count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus IN ('F', 'O')), 0) AS d FROM o WHERE year(o_orderdate) % 2 = 1 GROUP BY k),
    scores AS (SELECT geo, chamber, avg(id % 5) AS resent FROM cu WHERE seat % 5 <> 2 GROUP BY ALL),
    sized AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY k, chamber) AS w FROM demo)
    SELECT s.geo AS "GEOID", s.chamber, i.impact, coalesce(f.n, 0) AS n_intro, coalesce(f.passed, 0) AS n_pass, (coalesce(f.n, 0) > 0)::INT * 100 AS sp_intro,
           (coalesce(f.passed, 0) > 0)::INT * 100 AS sp_pass, s.k IN (1, 48, 40, 22, 28, 5, 12, 13, 47, 45, 37, 21, 51, 54) AS south, d > 0.45 AND d < 0.55 AS competitive,
           n_regionkey = 0 AS r, round(w, 6) AS w, round(white * 100, 6) AS nh_white, round(state_white * 100, 6) AS state_nh_white, round((1 - share) * 100, 6) AS share_rep,
           round(income / 10000, 11) AS median_income, round(age, 6) AS median_age, round(ln(people), 6) AS population, round(college * 100, 6) AS some_college,
           round(CASE WHEN before <> 0 THEN white / before END, 6) AS change_white, round(resent, 6) AS resent
    FROM sized s CROSS JOIN (VALUES ('R'), ('N'), ('E')) AS i(impact) JOIN nation ON n_nationkey = s.k JOIN around USING (k) JOIN share USING (geo, chamber)
      JOIN d20 ON d20.k = s.k LEFT JOIN early e ON e.geo = s.geo AND e.chamber = s.chamber LEFT JOIN scores c ON c.geo = s.geo AND c.chamber = s.chamber
      LEFT JOIN facts f ON f.geo = s.geo AND f.chamber = s.chamber AND f.impact = i.impact
    WHERE n_regionkey <> 1 AND d IS NOT NULL AND share IS NOT NULL
    """,
)
def district_panel_study(t: Tables) -> DataFrame:
    """Twelve seats and two chambers in every nation: people, votes, sponsors and scores meet in one row per district and impact."""

    def place(nation: str, key: str) -> list:
        number = F.lpad((F.col(key) % 12).cast("string"), 3, "0")
        return [
            F.concat(F.lpad(F.col(nation).cast("string"), 2, "0"), number).alias("GEOID"),
            F.when(F.col(key) % 2 == 0, "HD").otherwise("SD").alias("chamber"), (F.col(key) % 12).alias("seat"),
        ]

    people = t.customer.select("c_custkey", "c_nationkey", "c_acctbal", *place("c_nationkey", "c_custkey"))
    share_of = lambda c: F.avg(c.cast("double"))
    demographics = people.groupBy("GEOID", "chamber").agg(
        F.count(F.lit(1)).cast("double").alias("population"), share_of(F.col("c_acctbal") > 0).alias("nh_white"), F.avg("c_acctbal").alias("median_income"),
        F.avg(F.col("c_custkey") % 90).alias("median_age"), share_of(F.col("c_custkey") % 3 == 0).alias("some_college"),
    )
    before = t.supplier.select("s_acctbal", *place("s_nationkey", "s_suppkey"))
    earlier = before.groupBy("GEOID", "chamber").agg(share_of(F.col("s_acctbal") > 0).alias("nh_white"))
    code = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    around = people.groupBy(code.alias("GEOID")).agg(share_of(F.col("c_acctbal") > 0).alias("nh_white"))
    of_order = t.orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.filter("l_quantity > 40").join(of_order.select("o_orderkey", "GEOID", "chamber"), F.col("l_orderkey") == F.col("o_orderkey"))
    kinds = {"E": F.col("l_returnflag") == "A", "R": F.col("l_returnflag") == "R", "N": F.col("l_returnflag") == "N"}
    counts = [F.count_if(is_kind).alias(f"n_{i}") for i, is_kind in kinds.items()]
    counts += [F.count_if(is_kind & (F.col("l_linestatus") == "F")).alias(f"n_pass_{i}") for i, is_kind in kinds.items()]
    sponsors = lines.groupBy(F.col("GEOID").alias("district"), "chamber").agg(*counts)
    sponsors = sponsors.withColumns({"state": F.lit(None).cast("string"), "party": F.lit("M")})
    won = F.count_if(F.col("o_orderstatus") == "F") / F.nullif(F.count_if(F.col("o_orderstatus").isin("F", "O")), F.lit(0))
    shares = of_order.filter("seat % 4 <> 0").groupBy("GEOID", "chamber").agg(won.alias("share_dem"))
    fallback = of_order.filter("seat % 3 <> 1").groupBy("GEOID", "chamber").agg(F.avg(F.col("o_orderkey") % 2).alias("share_dem"))
    named = of_order.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    party = F.when(F.col("o_orderstatus") == "F", "DEMOCRAT").when(F.col("o_orderstatus") == "O", "REPUBLICAN").otherwise("OTHER")
    year = F.when(F.year(F.col("o_orderdate").cast("date")) % 2 == 0, 2016).otherwise(2020)
    votes = named.groupBy(F.col("n_name").alias("state"), party.alias("party_simplified"), year.alias("year")).agg(F.count(F.lit(1)).alias("candidatevotes"))
    control = t.nation.select(F.col("n_name").alias("NAME"), F.when(F.col("n_regionkey") == 0, "Rep").when(F.col("n_regionkey") != 1, "Dem").alias("control"))
    states = t.nation.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("state_code"), F.col("n_name").alias("state_name"))
    scores = people.filter("seat % 5 <> 2").groupBy("GEOID", "chamber").agg(F.avg(F.col("c_custkey") % 5).alias("resent"))
    panel = study.district_panel(demographics, earlier, sponsors, around, shares, fallback, votes, control, states, scores)
    numbers = [
        "w", "nh_white", "state_nh_white", "share_rep", "median_income", "median_age", "population", "some_college", "change_white", "resent",
    ]
    plain = ["GEOID", "chamber", "impact", "n_intro", "n_pass", "sp_intro", "sp_pass", "south", "competitive", "r"]
    return panel.select(*plain, *[rounded(c, 11 if c == "median_income" else 6).alias(c) for c in numbers])
