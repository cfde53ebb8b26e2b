"""Point-in-polygon against brute force, with every lookup path."""

import random
from collections import Counter

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from civicframe.operators import spatial
from civicframe.sources.local import small_frame

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def inside(rings, x, y):
    odd = False
    for r in rings:
        pts = [(p["x"], p["y"]) for p in r]
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def polygons(spark, shapes):
    schema = f"id int, state string, rings {RINGS}"
    return spark.createDataFrame(shapes, schema)


SQUARE = [ring((0, 0), (4, 0), (4, 4), (0, 4))]
NOTCH = [ring((4, 0), (8, 0), (8, 4), (6, 1), (4, 4))]
HOLED = [ring((0, 4), (8, 4), (8, 8), (0, 8)), ring((2, 5), (2, 7), (4, 7), (4, 5))]
TWO_PARTS = [ring((10, 0), (11, 0), (11, 1), (10, 1)), ring((12, 0), (13, 0), (13, 1), (12, 1))]
TINY = [ring((20, 20), (20.01, 20), (20.01, 20.01), (20, 20.01))]
WIDE = [ring((-100, -100), (100, -100), (100, -90), (-100, -95))]
SHAPES = [(1, "A", SQUARE), (2, "A", NOTCH), (3, "B", HOLED), (4, "A", TWO_PARTS), (5, "B", TINY), (6, "A", WIDE), (7, "A", SQUARE)]


def points(n=900, seed=5):
    rng = random.Random(seed)
    out = [(rng.uniform(-1, 14), rng.uniform(-1, 9)) for _ in range(n)]
    out += [(rng.uniform(19.99, 20.02), rng.uniform(19.99, 20.02)) for _ in range(60)]
    out += [(rng.uniform(-110, 110), rng.uniform(-101, -89)) for _ in range(200)]
    out += [(float(x), float(y)) for x in range(-1, 15) for y in range(-1, 10)]
    return out


@pytest.fixture(scope="module")
def cloud(spark):
    data = [(i, "A" if i % 2 else "B", x, y) for i, (x, y) in enumerate(points())] + [(-1, "A", None, 1.0)]
    return small_frame(spark, data, "pid int, state string, x double, y double").persist()


def expected(data, shapes, by_state):
    out = {}
    for pid, state, x, y in data:
        hits = [] if x is None else [i for i, s, r in shapes if (not by_state or s == state) and inside(r, x, y)]
        out[pid] = min(hits) if hits else None
    return out


@pytest.mark.parametrize("threshold", ["10m", "-1"])
@pytest.mark.parametrize("by_state", [False, True])
def test_assignment(spark, cloud, threshold, by_state):
    shapes = polygons(spark, SHAPES)
    if not by_state:
        shapes = shapes.drop("state")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = spatial.assign_polygon(cloud, "x", "y", shapes, "id", "hit", within=["state"] if by_state else [])
        assert set(got.columns) == {"pid", "state", "x", "y", "hit"}
        found = {r["pid"]: r["hit"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    data = [tuple(r) for r in cloud.collect()]
    assert len(found) == len(data) and found == expected(data, SHAPES, by_state)


def test_crowded_cells(spark, cloud):
    """Hundreds of polygons over the same place, of mixed sizes."""
    rng = random.Random(4)
    shapes = []
    for i in range(400):
        half = 10 ** rng.uniform(-1, 1.2)
        cx, cy = rng.uniform(3, 7), rng.uniform(2, 6)
        shapes.append((i, "A", [ring((cx - half, cy - half), (cx + half, cy - half), (cx + half, cy + half), (cx - half, cy + half))]))
    shapes = [(400 - i, s, r) for i, s, r in shapes]
    got = spatial.assign_polygon(cloud, "x", "y", polygons(spark, shapes).drop("state"), "id", "hit")
    data = [tuple(r) for r in cloud.collect()]
    assert {r["pid"]: r["hit"] for r in got.collect()} == expected(data, shapes, False)


def test_random_triangles(spark, cloud):
    rng = random.Random(9)
    shapes = []
    for i in range(60):
        cx, cy, r = rng.uniform(-1, 14), rng.uniform(-1, 9), 10 ** rng.uniform(-2, 1)
        shapes.append((i, "A", [ring(*[(cx + rng.uniform(-r, r), cy + rng.uniform(-r, r)) for _ in range(3)])]))
    got = spatial.assign_polygon(cloud, "x", "y", polygons(spark, shapes).drop("state"), "id", "hit")
    data = [tuple(r) for r in cloud.collect()]
    assert {r["pid"]: r["hit"] for r in got.collect()} == expected(data, shapes, False)


def test_shared_border_belongs_to_one_side(spark):
    pts = small_frame(spark, [(4.0, float(y)) for y in range(5)], "x double, y double")
    shapes = polygons(spark, [(1, "A", SQUARE), (2, "A", [ring((4, 0), (8, 0), (8, 4), (4, 4))])]).drop("state")
    got = spatial.assign_polygon(pts, "x", "y", shapes, "id", "hit")
    assert [r["hit"] for r in got.orderBy("y").collect()] == [2, 2, 2, 2, None]


def test_no_polygons(spark, cloud):
    got = spatial.assign_polygon(cloud, "x", "y", polygons(spark, []).drop("state"), "id", "hit")
    assert got.filter("hit is not null").count() == 0 and got.count() == cloud.count()


def test_layers_of_other_key_types_in_one_index(spark, cloud):
    odd = cloud.unionByName(small_frame(spark, [(-2, None, float("nan"), 1.0), (-3, "C", 1e300, -1e300)], cloud.schema))
    named = polygons(spark, SHAPES).withColumn("name", F.concat(F.lit("n"), "id"))
    got = spatial.assign_layers(odd, "x", "y", {"a": (named, "id"), "b": (named.filter("id > 2"), "name"), "c": (named.limit(0), "id")})
    data = [tuple(r) for r in odd.collect()]
    a, b = expected(data, SHAPES, False), expected(data, [s for s in SHAPES if s[0] > 2], False)
    assert {r["pid"]: (r["a"], r["b"], r["c"]) for r in got.collect()} == {p: (a[p], f"n{b[p]}" if b[p] else None, None) for p in a}


def test_copies_of_a_polygon_are_indexed_once(spark, cloud):
    """However many copies a layer has, its shapes and cells are those of the distinct polygons with the lowest keys."""
    copies = polygons(spark, [(100 * n + k, state, r) for k, state, r in SHAPES for n in range(30)])
    once = polygons(spark, SHAPES[:-1])
    for within in ([], ["state"]):
        many, few = (spatial._shapes({"a": (p, "id")}, "rings", within) for p in (copies, once))
        assert rows(many, "layer", "key", "within", "x0", "y0") == rows(few, "layer", "key", "within", "x0", "y0")
    assert spatial._index(spatial._shapes({"a": (copies, "id")}, "rings", [])).count() == spatial._index(spatial._shapes({"a": (once, "id")}, "rings", [])).count()
    found = spatial.assign_polygon(cloud, "x", "y", copies.drop("state"), "id", "hit")
    assert rows(found, "pid", "hit") == rows(spatial.assign_polygon(cloud, "x", "y", once.drop("state"), "id", "hit"), "pid", "hit")


def test_cells_are_cut_where_edges_are(spark):
    rng = random.Random(2)
    shapes = [(i, "A", [ring((x, y), (x + 0.001, y), (x, y + 0.001))]) for i in range(300) for x, y in [(50 + rng.random() / 50, 50 + rng.random() / 50)]]
    shapes.append((999, "A", [ring((0, 0), (100, 0), (100, 100), (0, 100))]))
    found = spatial._index(spatial._shapes({"a": (polygons(spark, shapes).drop("state"), "id")}, "rings", [])).collect()
    tree = list({(r["level"], r["ix"], r["iy"]): r for r in found}.values())
    top = max(r["level"] for r in tree)
    fine = [r for r in tree if r["level"] < top]
    assert len({r["level"] for r in tree}) > 3 and all(48 <= r["ix"] * 2.0 ** r["level"] < 52 for r in fine)
    # The cells lie side by side: together they have the area of the grid.
    grid = tree[0]["grid"]
    assert sum(4.0 ** r["level"] for r in tree) == (grid["gx1"] - grid["gx0"] + 1) * (grid["gy1"] - grid["gy0"] + 1) * 4.0**top
    held = Counter()
    for r in found:
        held[r["level"], r["ix"], r["iy"]] += len(r["e"])
    assert max(held.values()) < 120


@pytest.mark.parametrize(
    "rings,want",
    [
        (SQUARE, (2.0, 2.0)),
        ([ring((1000, 0), (1006, 0), (1003, 3))], (1003.0, 1.0)),
        ([ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 3), (2, 3), (2, 1))], ((32 - 3) / 14, 2.0)),
        (TWO_PARTS, (11.5, 0.5)),
        ([ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))], (2.0, 2.0)),
    ],
)
def test_centroids(spark, rings, want):
    got = one(polygons(spark, [(1, "A", rings)]).select(spatial.centroid(F.col("rings")).alias("c")))["c"]
    assert (round(got["x"], 9), round(got["y"], 9)) == tuple(round(w, 9) for w in want)


def test_flat_polygon_has_no_centroid(spark):
    flat = [ring((0, 0), (1, 1), (2, 2))]
    assert one(polygons(spark, [(1, "A", flat)]).select(spatial.centroid(F.col("rings")).alias("c")))["c"] is None


def test_one_lookup_per_layer(spark, cloud):
    shapes = polygons(spark, SHAPES).drop("state")
    got = spatial.assign_layers(cloud, "x", "y", {"a": (shapes, "id"), "b": (shapes, "id")})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert len(rows(got)) == cloud.count()
