"""Queries over polygons, points and areal crosswalks.

Zones come from the nation table: each nation is a concave shape with a square
hole, of one of several sizes.  Points come from orders and line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..functions.nulls import weighted_mean
from ..operators import aggregate, joins, spatial
from . import study
from .crosswalk import areal_share, score_by_area
from .registry import Tables, query, rounded

#: Unit shape: outer ring (a square with a notch in its top) and a hole run the other way.
OUTER = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.5), (0.0, 1.0)]
HOLE = [(0.25, 0.125), (0.25, 0.375), (0.5, 0.375), (0.5, 0.125)]


def _rings(cx: Column, cy: Column, size: Column, rings) -> Column:
    def ring(points):
        return F.array(*[F.struct((cx + size * px).alias("x"), (cy + size * py).alias("y")) for px, py in points])

    return F.array(*[ring(r) for r in rings])


def zones(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    cx, cy = (k % 5 * 10).cast("double"), (F.floor(k / 5) * 10).cast("double")
    size = (F.lit(10) - k % 4 * 2).cast("double")
    return t.nation.select(k.alias("zone"), F.col("n_regionkey").alias("state"), _rings(cx, cy, size, [OUTER, HOLE]).alias("rings"))


def strips(t: Tables) -> DataFrame:
    """Five overlapping wide shapes; a point in two belongs to the lower key."""
    k = F.col("r_regionkey")
    return t.region.select(
        k.alias("strip"), _rings(F.lit(0.0), (k * 8).cast("double"), F.lit(45.0), [[(0.0, 0.0), (1.0, 0.1), (1.0, 0.4), (0.0, 0.2)]]).alias("rings")
    )


def squares(t: Tables) -> DataFrame:
    """Postal areas: one 9 by 9 square per nation, shifted against the zones."""
    k = F.col("n_nationkey")
    cx, cy = (k % 5 * 10 + 1).cast("double"), (F.floor(k / 5) * 10 + 2).cast("double")
    return t.nation.select(
        text.pad_left(k.cast("string"), 5).alias("zip"),
        _rings(cx, cy, F.lit(9.0), [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]).alias("rings"),
    )


_SHAPES = """
    WITH zv AS (SELECT n_nationkey AS zone, n_regionkey AS state, ring, i, (n_nationkey % 5 * 10)::DOUBLE + (10 - n_nationkey % 4 * 2)::DOUBLE * px AS x,
                       (n_nationkey // 5 * 10)::DOUBLE + (10 - n_nationkey % 4 * 2)::DOUBLE * py AS y
                FROM nation, (VALUES (0, 0, 0.0::DOUBLE, 0.0::DOUBLE), (0, 1, 1.0, 0.0), (0, 2, 1.0, 1.0), (0, 3, 0.5, 0.5), (0, 4, 0.0, 1.0),
                                     (1, 0, 0.25, 0.125), (1, 1, 0.25, 0.375), (1, 2, 0.5, 0.375), (1, 3, 0.5, 0.125)) AS u(ring, i, px, py)),
    zone_edges AS (SELECT zone, state, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2,
                          coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM zv WINDOW w AS (PARTITION BY zone, ring ORDER BY i)),
    sv AS (SELECT r_regionkey AS strip, i, 0.0::DOUBLE + 45.0::DOUBLE * px AS x, (r_regionkey * 8)::DOUBLE + 45.0::DOUBLE * py AS y
           FROM region, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 1.0, 0.1), (2, 1.0, 0.4), (3, 0.0, 0.2)) AS u(i, px, py)),
    strip_edges AS (SELECT strip, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2,
                           coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM sv WINDOW w AS (PARTITION BY strip ORDER BY i)),
    qv AS (SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS zip, i, (n_nationkey % 5 * 10 + 1)::DOUBLE + 9.0::DOUBLE * px AS x,
                  (n_nationkey // 5 * 10 + 2)::DOUBLE + 9.0::DOUBLE * py AS y
           FROM nation, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)) AS u(i, px, py)),
    square_edges AS (SELECT zip, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2,
                            coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM qv WINDOW w AS (PARTITION BY zip ORDER BY i))
"""


def _hits(points: str, edges: str, key: str, id_: str = "id", also: str = "") -> str:
    return f"""(SELECT {id_}, min({key}) AS {key} FROM (
        SELECT {id_}, {key} FROM {points} p JOIN {edges} e ON (y1 > y) <> (y2 > y) {also}
          AND x < (x2 - x1) * (y - y1) / (CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END) + x1
        GROUP BY {id_}, {key} HAVING count(*) % 2 = 1) GROUP BY {id_})"""


def order_points(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") / 10000).alias("x"),
        ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 5000 / 100.0).alias("y"),
    )


_ORDER_POINTS = """, pts AS (SELECT o_orderkey AS id, o_custkey % 5 AS pstate, o_totalprice / 10000 AS x,
                                    ((o_custkey * 7 + o_orderkey) % 5000) / 100.0::DOUBLE AS y FROM orders)"""


@query(
    "point_in_polygon",
    _SHAPES + _ORDER_POINTS
    + f""" SELECT id AS o_orderkey, zone, strip FROM pts LEFT JOIN {_hits('pts', 'zone_edges', 'zone')} USING (id)
           LEFT JOIN {_hits('pts', 'strip_edges', 'strip')} USING (id)""",
)
def point_in_polygon(t: Tables) -> DataFrame:
    found = spatial.assign_layers(order_points(t), "x", "y", {"zone": (zones(t), "zone"), "strip": (strips(t), "strip")})
    return found.select("o_orderkey", "zone", "strip")


@query(
    "point_in_polygon_by_state",
    _SHAPES + _ORDER_POINTS
    + f" SELECT id AS o_orderkey, pstate AS state, zone FROM pts LEFT JOIN {_hits('pts', 'zone_edges', 'zone', also='AND pstate = state')} USING (id)",
)
def point_in_polygon_by_state(t: Tables) -> DataFrame:
    """The state is an equality key, so a point meets the polygons of its own state only."""
    points = order_points(t).withColumn("state", F.col("o_custkey") % 5)
    found = spatial.assign_polygon(points, "x", "y", zones(t), "zone", "zone", within=["state"])
    return found.select("o_orderkey", "state", "zone")


@query(
    "point_in_many_polygons",
    """
    WITH pts AS (SELECT o_orderkey, o_totalprice / 10000 AS x, ((o_custkey * 7 + o_orderkey) % 5000) / 100.0::DOUBLE AS y FROM orders),
    box AS (SELECT p_partkey, (p_partkey * 37 % 5000) / 100.0::DOUBLE AS cx, (p_partkey * 91 % 5000) / 100.0::DOUBLE AS cy,
                   p_size * p_size / 512.0::DOUBLE AS h FROM part)
    SELECT o_orderkey, min(p_partkey) AS part FROM pts
      LEFT JOIN box ON x >= cx - h AND x < cx + h AND y >= cy - h AND y < cy + h GROUP BY o_orderkey
    """,
)
def point_in_many_polygons(t: Tables) -> DataFrame:
    """A square for every part, of mixed sizes and over each other; a point belongs to the lowest part."""
    key = F.col("p_partkey")
    half = F.col("p_size") * F.col("p_size") / 512.0
    cx, cy = (key * 37 % 5000) / 100.0, (key * 91 % 5000) / 100.0
    corner = lambda sx, sy: F.struct((cx + half * sx).alias("x"), (cy + half * sy).alias("y"))
    rings = F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))
    squares_ = t.part.select(key.alias("part"), rings.alias("rings"))
    return spatial.assign_polygon(order_points(t), "x", "y", squares_, "part", "part").select("o_orderkey", "part")


@query(
    "centroid",
    _SHAPES
    + """
    SELECT zone, round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS x,
           round(sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS y
    FROM zone_edges GROUP BY zone
    """,
)
def centroid(t: Tables) -> DataFrame:
    middle = zones(t).withColumn("c", spatial.centroid(F.col("rings")))
    return middle.select("zone", rounded("c.x").alias("x"), rounded("c.y").alias("y"))


def blocks(t: Tables) -> DataFrame:
    """Line items as census blocks: a point and a population."""
    return t.lineitem.select(
        "l_suppkey", F.col("l_quantity").cast("long").alias("POP20"), (F.col("l_extendedprice") / 2000).alias("x"),
        ((F.col("l_partkey") * 13 + F.col("l_suppkey") * 7) % 5000 / 100.0).alias("y"),
    )


_BLOCKS = """, b AS (SELECT row_number() OVER () AS id, l_suppkey, CAST(l_quantity AS BIGINT) AS pop, l_extendedprice / 2000 AS x,
                            ((l_partkey * 13 + l_suppkey * 7) % 5000) / 100.0::DOUBLE AS y FROM lineitem)"""


@query(
    "areal_crosswalk",
    _SHAPES + _BLOCKS
    + f""", survey AS (SELECT lpad(c_nationkey::VARCHAR, 5, '0') AS zip,
                avg(((6 - (1 + c_custkey % 5)) + CASE WHEN c_acctbal > 0 AND c_nationkey <> 7 THEN 1 + (c_custkey // 5) % 5 END) / 2.0) AS rr
         FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1),
    a AS (SELECT b.*, zone, strip, rr FROM b LEFT JOIN {_hits('b', 'zone_edges', 'zone')} USING (id)
          LEFT JOIN {_hits('b', 'strip_edges', 'strip')} USING (id) LEFT JOIN {_hits('b', 'square_edges', 'zip')} USING (id)
          LEFT JOIN survey USING (zip))
    SELECT zone AS "GEOID", 'SD' AS chamber, round(sum(rr * pop) / nullif(sum(CASE WHEN rr IS NOT NULL THEN pop END), 0), 6) AS resent, count(*) AS n FROM a GROUP BY 1
    UNION ALL
    SELECT strip, 'HD', round(sum(rr * pop) / nullif(sum(CASE WHEN rr IS NOT NULL THEN pop END), 0), 6), count(*) FROM a GROUP BY 1
    """,
)
def areal_crosswalk(t: Tables) -> DataFrame:
    layers = {"upper": (zones(t), "zone"), "lower": (strips(t), "strip"), "zip": (squares(t), "zip")}
    placed = spatial.assign_layers(blocks(t), "x", "y", layers)
    a = 1 + F.col("c_custkey") % 5
    # Nobody of nation 7 gave the second answer, so that area has no score.
    b = F.when((F.col("c_acctbal") > 0) & (F.col("c_nationkey") != 7), 1 + F.floor(F.col("c_custkey") / 5) % 5)
    answers = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(
        text.pad_left(F.col("c_nationkey").cast("string"), 5).alias("zip"),
        ((numeric.reverse_scale(a, 5) + b) / 2.0).alias("rr"),
    )
    scores = score_by_area(placed, answers, "zip", "rr", "POP20", {"SD": "upper", "HD": "lower"}, "resent")
    return scores.select("GEOID", "chamber", rounded("resent").alias("resent"), "n")


@query(
    "block_crosswalk",
    _SHAPES + _BLOCKS.replace("l_suppkey,", "l_suppkey, l_suppkey % 5 AS pstate,")
    + f""" SELECT zone AS upper, strip AS lower, zip, count(*) AS blocks, CAST(sum(pop) AS BIGINT) AS people
           FROM b LEFT JOIN {_hits('b', 'zone_edges', 'zone', also='AND pstate = state')} USING (id)
           LEFT JOIN {_hits('b', 'strip_edges', 'strip', also='AND pstate = strip')} USING (id)
           LEFT JOIN {_hits('b', 'square_edges', 'zip')} USING (id) GROUP BY ALL""",
)
def block_crosswalk(t: Tables) -> DataFrame:
    """Blocks in the districts of their own state and in postal areas of any."""
    rows = blocks(t).select(
        "POP20", (F.col("l_suppkey") % 5).cast("int").alias("state"), F.col("x").cast("string").alias("INTPTLON20"), F.col("y").cast("string").alias("INTPTLAT20")
    )
    upper = zones(t).withColumnRenamed("zone", "GEOID")
    lower = strips(t).select(F.col("strip").alias("GEOID"), F.col("strip").alias("state"), "rings")
    zips = squares(t).withColumnRenamed("zip", "GEOID")
    placed = study.block_crosswalk(rows, upper, lower, zips)
    return placed.groupBy("upper", "lower", "zip").agg(F.count(F.lit(1)).alias("blocks"), F.sum("POP20").alias("people"))


@query(
    "crosswalk_fallback",
    _SHAPES + _BLOCKS + _ORDER_POINTS
    + f""", results AS (SELECT c_nationkey AS county, CASE WHEN c_nationkey <> 3 THEN sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END)
             / nullif(sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice END), 0) END AS share
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    a AS (SELECT b.*, strip, share FROM b LEFT JOIN {_hits('b', 'strip_edges', 'strip')} USING (id)
          JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN results ON s_nationkey = county),
    fallback AS (SELECT strip, CASE WHEN count(*) FILTER (share IS NULL AND pop <> 0) = 0 THEN sum(share * pop) / nullif(sum(pop), 0) END AS share
                 FROM a GROUP BY 1),
    prim AS (SELECT strip, CASE WHEN strip < 3 THEN count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus IN ('F', 'O')), 0) END AS share
             FROM pts JOIN orders ON id = o_orderkey LEFT JOIN {_hits('pts', 'strip_edges', 'strip')} USING (id) GROUP BY 1)
    SELECT strip AS "GEOID", 'primary' AS source, round(share, 6) AS share_dem FROM prim WHERE share IS NOT NULL
    UNION ALL SELECT strip, 'fallback', round(share, 6) FROM fallback
      WHERE NOT EXISTS (SELECT 1 FROM prim WHERE prim.share IS NOT NULL AND prim.strip IS NOT DISTINCT FROM fallback.strip)
    """,
)
def crosswalk_fallback(t: Tables) -> DataFrame:
    """County shares carried to districts by population, where no direct share exists."""
    district = {"strip": (strips(t), "strip")}
    placed = spatial.assign_layers(blocks(t), "x", "y", district)
    county = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("county"))
    placed = joins.left_join(placed, county, [("l_suppkey", "s_suppkey")], null_safe=False)
    party = F.col("o_orderstatus") == "F"
    price = F.col("o_totalprice")
    decided = F.col("o_orderstatus").isin("F", "O")
    by_customer = t.orders.groupBy("o_custkey").agg(
        F.sum(F.when(party, price).otherwise(0.0)).alias("dem"), F.sum(F.when(decided, price)).alias("all")
    )
    nations = t.customer.select("c_custkey", F.col("c_nationkey").alias("county"))
    votes = joins.left_join(by_customer, nations, [("o_custkey", "c_custkey")], null_safe=False)
    # County 3 reports no result; strips from 3 on have no direct one.
    results = votes.groupBy("county").agg(
        F.when(F.col("county") != 3, F.try_divide(F.sum("dem"), F.sum("all"))).alias("share_dem")
    )
    fallback = areal_share(placed, results, "county", "share_dem", "POP20", {"": "strip"}).drop("chamber")
    points = spatial.assign_layers(order_points(t), "x", "y", district)
    share = aggregate.conditional_ratio(F.when(decided, F.lit(1)), party)
    primary = points.groupBy(F.col("strip").alias("GEOID")).agg(F.when(F.col("strip") < 3, share).alias("share_dem"))
    marked = [df.withColumn("source", F.lit(s)) for df, s in ((primary, "primary"), (fallback, "fallback"))]
    both = joins.prefer_first(*marked, ["GEOID"], "share_dem")
    return both.select("GEOID", "source", rounded("share_dem").alias("share_dem"))


@query(
    "weighted_mean_direct",
    """
    SELECT l_returnflag, l_linestatus, round(sum(CASE WHEN l_tax > 0.01 THEN l_extendedprice * l_quantity END)
             / sum(CASE WHEN l_tax > 0.01 THEN l_quantity END), 4) AS price FROM lineitem GROUP BY ALL
    """,
)
def weighted_mean_direct(t: Tables) -> DataFrame:
    x = F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice"))
    price = weighted_mean(x, F.col("l_quantity"))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(rounded(price, 4).alias("price"))
