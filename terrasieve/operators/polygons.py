"""Joins of points with tables of polygons (rings ``polygon, corners``), by equi joins on cells.

A polygon is covered with cells of a square grid: cells that an edge touches, and cells wholly
inside. A point in an inner cell is inside; a point in a cell of an edge is settled by the edges
that cross its row of cells. A point lies in a polygon if a ray to the right crosses its edges an
odd number of times; an edge holds its lower end and not its upper. So rings inside rings are
holes, and parts of one polygon needn't touch. Null polygons, corners and places match nothing;
rings of fewer than three corners hold nothing, but their edges have distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By how much of a cell the cells of an edge are widened against rounding.
SLACK = 1e-9


def edges(rings: DataFrame) -> DataFrame:
    """``polygon, x1, y1, x2, y2``: each corner with the next one of its ring."""
    known = F.filter("corners", lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())
    held = rings.where("polygon is not null").select("polygon", known.alias("c")).where(F.size("c") > 0)
    following = F.concat(F.slice("c", F.lit(2), F.size("c") - 1), F.slice("c", F.lit(1), F.lit(1)))
    pairs = held.select("polygon", F.explode(F.arrays_zip(F.col("c").alias("a"), following.alias("b"))).alias("e"))
    out = pairs.select("polygon", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    return out.where("x1 <> x2 or y1 <> y2")


def bounds(rings: DataFrame) -> DataFrame:
    """``polygon, left, bottom, right, top`` of each polygon."""
    e = edges(rings)
    return e.groupBy("polygon").agg(F.min("x1").alias("left"), F.min("y1").alias("bottom"), F.max("x1").alias("right"), F.max("y1").alias("top"))


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width))


def _rows(e: DataFrame, width: float, margin: float = 0.0) -> DataFrame:
    """Edges with each row of cells ``gy`` that they come near."""
    low, high = F.least("y1", "y2") - margin, F.greatest("y1", "y2") + margin
    slack = SLACK * width
    return e.withColumn("gy", F.explode(F.sequence(_cell(low - slack, width), _cell(high + slack, width))))


def edge_cells(e: DataFrame, width: float, margin: float = 0.0) -> DataFrame:
    """Edges with each cell ``gx, gy`` that lies within ``margin`` of them, and a few more."""
    rows = _rows(e, width, margin)
    # The part of the edge that the row of cells, widened by the margin, holds.
    low, high = F.col("gy") * width - margin, (F.col("gy") + 1) * width + margin
    rise = F.col("y2") - F.col("y1")
    part = lambda y: F.when(rise == 0, None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("y1")) / rise)))
    x = lambda t, flat: F.coalesce(F.col("x1") + t * (F.col("x2") - F.col("x1")), flat)
    a, b = x(part(low), F.col("x1")), x(part(high), F.col("x2"))
    slack = margin + SLACK * width
    span = F.sequence(_cell(F.least(a, b) - slack, width), _cell(F.greatest(a, b) + slack, width))
    return rows.withColumn("gx", F.explode(span))


def _crossing(y: Column) -> Column:
    """Where an edge crosses a height, null if it doesn't."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return F.when((y1 > y) != (y2 > y), (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def cover(rings: DataFrame, width: float) -> DataFrame:
    """``polygon, gx, gy, inner``: the cells that each polygon touches; ``inner`` ones lie inside
    as a whole. Along the middle of a row of cells every second stretch between edges is inside."""
    e = edges(rings)
    touched = edge_cells(e, width).select("polygon", "gx", "gy").distinct()
    middle = (F.col("gy") + 0.5) * width
    crossed = _rows(e, width).select("polygon", "gy", _crossing(middle).alias("x")).where("x is not null")
    sorted_x = crossed.groupBy("polygon", "gy").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # edges of one row
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("a"), F.get("xs", 2 * i + 1).alias("b")))
    spans = sorted_x.where(F.size("xs") >= 2).select("polygon", "gy", F.explode(pairs).alias("p"))
    low, high = F.ceil(F.col("p.a") / width - 0.5), F.ceil(F.col("p.b") / width - 0.5) - 1
    cells = spans.where(low <= high).select("polygon", F.explode(F.sequence(low, high)).alias("gx"), "gy").distinct()
    inner = cells.join(touched, ["polygon", "gx", "gy"], "left_anti")
    return touched.select("*", F.lit(False).alias("inner")).unionByName(inner.select("*", F.lit(True).alias("inner")))


def union_cells(covers: DataFrame) -> DataFrame:
    """``gx, gy, inner`` of the union of all polygons: inner if any polygon holds the cell."""
    return covers.groupBy("gx", "gy").agg(F.max("inner").alias("inner"))


def points_in(points: DataFrame, rings: DataFrame, width: float) -> DataFrame:
    """``id, polygon`` of each point (``id, x, y``) and each polygon that holds it."""
    placed = points.select("id", "x", "y", _cell(F.col("x"), width).alias("gx"), _cell(F.col("y"), width).alias("gy"))
    met = placed.join(cover(rings, width), ["gx", "gy"]).select("id", "x", "y", "polygon", "gy", "inner")
    rows = _rows(edges(rings), width)
    right = F.count_if(F.col("x") < _crossing(F.col("y")))
    near = met.where("not inner").join(rows, ["polygon", "gy"])
    settled = near.groupBy("id", "x", "y", "polygon").agg(right.alias("n")).where(F.col("n") % 2 == 1)
    return met.where("inner").select("id", "polygon").unionByName(settled.select("id", "polygon"))


def distance_to_edge(x: Column, y: Column) -> Column:
    """From a place to the nearest place of an edge."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def points_near(points: DataFrame, rings: DataFrame, radius: float) -> DataFrame:
    """``id, polygon, d`` of each point and each polygon at most a radius away; 0 inside."""
    placed = points.select("id", "x", "y", _cell(F.col("x"), radius).alias("gx"), _cell(F.col("y"), radius).alias("gy"))
    d = distance_to_edge(F.col("x"), F.col("y"))
    near = placed.join(edge_cells(edges(rings), radius, radius), ["gx", "gy"]).select("id", "polygon", d.alias("d")).where(F.col("d") <= radius)
    inside = points_in(points, rings, radius).withColumn("d", F.lit(0.0))
    return near.unionByName(inside).groupBy("id", "polygon").agg(F.min("d").alias("d"))


def outside(points: DataFrame, rings: DataFrame, width: float, radius: float = 0.0) -> DataFrame:
    """The points that no polygon holds, or comes as near to as the radius."""
    taken = points_near(points, rings, radius) if radius > 0 else points_in(points, rings, width)
    return points.join(taken.select("id").distinct(), "id", "left_anti")


def inside_any(points: DataFrame, rings: DataFrame, width: float) -> DataFrame:
    """The points that the union of all polygons holds."""
    return points.join(points_in(points, rings, width).select("id").distinct(), "id", "left_semi")
