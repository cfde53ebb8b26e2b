"""Point-in-polygon assignment and centroids from plain array columns.

A polygon is ``rings array<array<struct<x:double,y:double>>>``; holes run the
other way round than the outer rings.  A point lies inside when a ray to the
right crosses an odd number of edges of all rings.  An edge is crossed when
exactly one of its ends is above the point (half-open in y), so a point on a
shared border belongs to one side only.

Polygons are indexed by an adaptive tree of square cells.  A coarse grid covers a layer;
a cell that holds too many edges, counted over all its polygons, is cut into 4 by 4 parts, and so on.  A cell keeps only the
edges a ray from it can meet; a polygon that covers it wholly keeps none and shuts out all
polygons with a higher key.  The cells that are not cut cover the layer's surroundings without overlap, so every point lies in exactly
one: points look up the cells above them at all sizes in one join, and one row of that finds its cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import scratch_dir

#: Edges of all polygons that a cell may hold before it is cut, and how often it may be (a corner that many polygons share never thins out).
CELL_EDGES, CUTS = 24, 10
#: Parts of a cell that is cut, along a side, and how much smaller they are as a power of two.
ACROSS, DEEPER = 4, 2
#: Cells of the first grid along the longer side of a layer.
GRID = 32


def edges_of(rings: Column) -> Column:
    """All edges of all rings as ``array<struct<x1,y1,x2,y2>>``; rings may be left open."""

    def ring_edges(ring: Column) -> Column:
        ends = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(
            ring,
            ends,
            lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")),
        )

    return F.flatten(F.transform(rings, ring_edges))


def crossed(edge: Column, x: Column, y: Column) -> Column:
    """Does a ray from (x, y) to the right cross the edge?"""
    at = (edge.x2 - edge.x1) * (y - edge.y1) / (edge.y2 - edge.y1) + edge.x1
    return F.when((edge.y1 > y) != (edge.y2 > y), x < at).otherwise(F.lit(False))


def contains(edges: Column, x: Column, y: Column) -> Column:
    return F.size(F.filter(edges, lambda e: crossed(e, x, y))) % 2 == 1


def centroid(rings: Column) -> Column:
    """Area centroid as ``struct<x,y>``; null for zero area.

    Coordinates are taken relative to the first vertex, which keeps the sums
    accurate far from the origin.
    """
    origin = F.get(F.get(rings, F.lit(0)), F.lit(0))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, e: Column) -> Column:
        x1, y1, x2, y2 = e.x1 - origin.x, e.y1 - origin.y, e.x2 - origin.x, e.y2 - origin.y
        cross = x1 * y2 - x2 * y1
        return F.struct(
            (acc.a + cross).alias("a"), (acc.x + (x1 + x2) * cross).alias("x"), (acc.y + (y1 + y2) * cross).alias("y")
        )

    def finish(acc: Column) -> Column:
        return F.when(
            acc.a != 0,
            F.struct((origin.x + acc.x / (acc.a * 3)).alias("x"), (origin.y + acc.y / (acc.a * 3)).alias("y")),
        )

    return F.aggregate(edges_of(rings), zero, step, finish)


def _shapes(layers: dict[str, tuple[DataFrame, str]], rings: str, within: Sequence[str]) -> DataFrame:
    """Polygons of all layers: layer number, key (a struct with one field a layer, so that each keeps its type), within, edges, extent.

    Of polygons with the same rings the one of the lowest key is all that a point can find, so a shape is indexed once, however many copies
    a layer has.  That also spreads the polygons of a small file over the tasks.
    """
    parts = []
    for i, (polygons, key) in enumerate(layers.values()):
        distinct = polygons.groupBy(F.col(rings).alias("__rings"), *within).agg(F.min(key).alias("__key"))
        fields = [
            (F.col("__key") if j == i else F.lit(None).cast(other.schema[k].dataType)).alias(f"k{j}")
            for j, (other, k) in enumerate(layers.values())
        ]
        parts.append(distinct.select(F.lit(i).alias("layer"), F.struct(*fields).alias("key"), F.struct(F.lit(0).alias("all"), *within).alias("within"), edges_of(F.col("__rings")).alias("e")))
    shapes = reduce(DataFrame.unionByName, parts).filter(F.size("e") > 0)
    xs, ys = F.transform("e", lambda e: e.x1), F.transform("e", lambda e: e.y1)
    return shapes.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})


def _grids(shapes: DataFrame) -> DataFrame:
    """One row a layer: the grid's cell size as a power of two, and its first and last columns and rows, one beyond all polygons."""
    ends = shapes.groupBy("layer").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-12))
    ends = ends.withColumn("top", F.ceil(F.log2(extent / GRID)).cast("int"))
    size = F.pow(F.lit(2.0), F.col("top"))
    return ends.select("layer", "top", *[
        (F.floor(F.col(end) / size) + step).alias(name)
        for name, end, step in (("gx0", "x0", -1), ("gx1", "x1", 1), ("gy0", "y0", -1), ("gy1", "y1", 1))
    ])


def _square(level: Column, ix: Column, iy: Column) -> tuple[Column, Column, Column, Column]:
    size = F.pow(F.lit(2.0), level)
    return ix * size, (ix + 1) * size, iy * size, (iy + 1) * size


def _met(edges: Column, level: Column, ix: Column, iy: Column) -> Column:
    """The edges that rays from a cell can meet."""
    left, _, low, high = _square(level, ix, iy)
    return F.filter(
        edges, lambda e: (F.least(e.y1, e.y2) < high) & (F.greatest(e.y1, e.y2) >= low) & (F.greatest(e.x1, e.x2) >= left)
    )


def _held(cells: DataFrame) -> DataFrame:
    """Cells of polygons that reach into them; ``n`` edges are in the cell itself, and a polygon without any covers it."""
    left, right, low, high = _square(F.col("level"), F.col("ix"), F.col("iy"))
    inside = F.col("inside") | contains(F.col("e"), (left + right) / 2, (low + high) / 2)
    cells = cells.withColumn("n", F.size(F.filter("e", lambda e: F.least(e.x1, e.x2) <= right)))
    cells = cells.withColumn("inside", (F.col("n") == 0) & inside).filter("n > 0 OR inside")
    return cells.withColumn("e", F.when(F.col("inside"), F.slice("e", 1, 0)).otherwise(F.col("e")))


_CELL = ("layer", "level", "ix", "iy")


def _first_cells(shapes: DataFrame) -> DataFrame:
    """The polygons in the cells of their layers' grids."""
    grids = _grids(shapes)
    grid = F.struct("top", "gx0", "gx1", "gy0", "gy1").alias("grid")
    placed = shapes.join(grids, "layer").withColumn("level", F.col("top"))
    size = F.pow(F.lit(2.0), F.col("top"))
    rows = placed.withColumn("iy", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size))))
    low, high = F.col("iy") * size, (F.col("iy") + 1) * size
    rows = rows.withColumn("e", F.filter("e", lambda e: (F.least(e.y1, e.y2) < high) & (F.greatest(e.y1, e.y2) >= low)))
    rows = rows.withColumn("ix", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size))))
    rows = rows.withColumn("e", _met(F.col("e"), F.col("level"), F.col("ix"), F.col("iy")))
    cells = _held(rows.select(*_CELL, grid, "key", "within", F.lit(False).alias("inside"), "e"))
    # Open ground: a row without a polygon keeps every cell of the grid, also the empty ones.
    ground = grids.withColumn("ix", F.explode(F.sequence("gx0", "gx1"))).withColumn("iy", F.explode(F.sequence("gy0", "gy1")))
    empty = [F.lit(None).cast(shapes.schema[c].dataType).alias(c) for c in ("key", "within")]
    no_edges = F.array().cast(shapes.schema["e"].dataType).alias("e")
    ground = ground.select("layer", F.col("top").alias("level"), "ix", "iy", grid, *empty, F.lit(True).alias("inside"), no_edges, F.lit(0).alias("n"))
    return cells.unionByName(ground)


def _parts(cells: DataFrame) -> DataFrame:
    """Each cell cut into ``ACROSS`` by ``ACROSS``."""

    def part(q: Column) -> Column:
        ix, iy = F.col("ix") * ACROSS + q % ACROSS, F.col("iy") * ACROSS + F.floor(q / ACROSS)
        level = F.col("level") - DEEPER
        return F.struct(level.alias("level"), ix.alias("ix"), iy.alias("iy"), _met(F.col("e"), level, ix, iy).alias("e"))

    parts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(ACROSS**2 - 1)), part)).alias("p")
    cells = cells.select("layer", "grid", "key", "within", F.col("inside").alias("whole"), parts)
    return _held(cells.select("layer", "p.level", "p.ix", "p.iy", "grid", "key", "within", F.col("whole").alias("inside"), "p.e"))


def _index(shapes: DataFrame) -> DataFrame:
    """The cells that are not cut, a row for each of their polygons: layer, level, ix, iy, grid, key, within, inside, e.

    A polygon that covers a cell shuts out those with a higher key.  Each depth of all layers is one job, which writes the cells that stay apart from those
    to be cut; the next depth reads only these, and there is none where no cell was cut.
    """
    spark, folder = shapes.sparkSession, scratch_dir(shapes.sparkSession)
    cell = Window.partitionBy(*_CELL)
    own = Window.partitionBy(*_CELL, "within") if len(shapes.schema["within"].dataType.fields) > 1 else cell
    cells, schema = _first_cells(shapes), None
    for depth in range(CUTS + 1):
        lowest = F.min(F.when(F.col("inside"), F.col("key"))).over(own)
        cells = cells.repartition(*_CELL).withColumn("lowest", lowest)
        cells = cells.filter("key IS NULL OR lowest IS NULL OR key <= lowest").drop("lowest")
        crowded = F.sum("n").over(cell) > CELL_EDGES if depth < CUTS else F.lit(False)
        cells = cells.withColumn("cut", F.coalesce(crowded, F.lit(False))).drop("n")
        schema = schema or T.StructType([*[f for f in cells.schema.fields if f.name not in ("cut", "layer")]])
        cells.write.partitionBy("cut", "layer").parquet(f"{folder}/depth={depth}")
        kinds = T.StructType([*schema.fields, T.StructField("depth", T.IntegerType()), T.StructField("cut", T.BooleanType()), T.StructField("layer", T.IntegerType())])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/depth={depth}/cut=true")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            break
        cells = _parts(spark.read.schema(kinds).option("basePath", folder).parquet(f"{folder}/depth={depth}").filter("cut"))
    return spark.read.schema(kinds).parquet(folder).filter("NOT cut").drop("depth", "cut")


def assign_layers(
    points: DataFrame, x: str, y: str, layers: dict[str, tuple[DataFrame, str]], *, rings: str = "rings", within: Sequence[str] = ()
) -> DataFrame:
    """Add one column per layer, ``{column: (polygons, key)}``: the lowest ``key`` whose polygon holds the point, else null.

    ``within`` lists columns (such as the state) that must be equal on both sides; a null there equals nothing.  All layers are indexed together in a
    table; Spark knows the size of that table and broadcasts it while it is small.  Beyond that points are shuffled once a layer, with one row for each size
    of cells that the layer has, and large partitions are split as skewed joins are.
    """
    if not layers:
        return points
    table = _index(_shapes(layers, rings, within))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    out = points
    for i, name in enumerate(layers):
        side = table.filter(F.col("layer") == i)
        beyond = F.col("grid.top") - F.col("level")
        extent = side.agg(F.max("grid").alias("grid"), F.min("level").alias("low"), F.max(beyond).alias("__deep"))
        at = out.crossJoin(F.broadcast(extent.withColumnsRenamed({"grid": "__grid", "low": "__low"})))
        size = F.pow(F.lit(2.0), F.col("__low"))

        def place(value: Column, first: str, last: str) -> Column:
            """The finest cell of a coordinate; beyond the grid its outermost cell, which holds nothing."""
            fine = F.pow(F.lit(2.0), F.col("__deep"))
            ends = F.col(f"__grid.{first}") * fine, (F.col(f"__grid.{last}") + 1) * fine - 1
            return F.floor(F.least(F.greatest(F.coalesce(value / size, ends[0]), ends[0]), ends[1]))

        at = at.withColumns({"__fx": place(px, "gx0", "gx1"), "__fy": place(py, "gy0", "gy1")})
        at = at.withColumn("__level", F.explode_outer(F.sequence(F.lit(0), F.col("__deep"), F.lit(DEEPER))))
        scale = F.pow(F.lit(2.0), F.col("__level"))
        at = at.withColumns({"__ix": F.floor(F.col("__fx") / scale), "__iy": F.floor(F.col("__fy") / scale), "__level": F.col("__low") + F.col("__level")})
        entry = F.when(F.col("key").isNotNull(), F.struct("key", "within", "inside", F.col("e").alias("edges")))
        side = side.groupBy(F.col("level").alias("__level"), F.col("ix").alias("__ix"), F.col("iy").alias("__iy"))
        side = side.agg(F.sort_array(F.collect_list(entry)).alias("__found"))
        at = at.join(side, ["__level", "__ix", "__iy"], "left").filter("__found IS NOT NULL OR __level IS NULL")

        def holds(p: Column) -> Column:
            same = reduce(lambda a, b: a & b, [p["within"][c] == F.col(c) for c in within], F.lit(True))
            return same & (p["inside"] | contains(p["edges"], px, py))

        first = F.get(F.filter("__found", holds), F.lit(0))
        hidden = ["__grid", "__low", "__deep", "__fx", "__fy", "__level", "__ix", "__iy", "__found"]
        out = at.withColumn(name, first["key"][f"k{i}"]).drop(*hidden)
    return out


def assign_polygon(
    points: DataFrame, x: str, y: str, polygons: DataFrame, key: str, name: str, *, rings: str = "rings", within: Sequence[str] = ()
) -> DataFrame:
    """``assign_layers`` for one layer: add column ``name``."""
    return assign_layers(points, x, y, {name: (polygons, key)}, rings=rings, within=within)
