"""Joins of points with points, centres, polygons and grid cells. Distances are found among
neighbouring cells of a grid as wide as the radius, by equi joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from .scratch import kept


def _cells(points: DataFrame, radius: float, spread: bool) -> DataFrame:
    gx, gy = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    if not spread:
        return points.withColumn("gx", gx).withColumn("gy", gy)
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    out = points.withColumn("__dx", F.explode(step)).withColumn("__dy", F.explode(step))
    return out.withColumn("gx", gx + F.col("__dx")).withColumn("gy", gy + F.col("__dy")).drop("__dx", "__dy")


def pairs_within(left: DataFrame, right: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """``id, other, d`` for points (``id, x, y``) of both sides at most (or less than) a radius
    apart. A point meets the points of nine cells."""
    a = _cells(left.select("id", "x", "y"), radius, False)
    b = _cells(right.select(F.col("id").alias("other"), "x", "y"), radius, True).withColumnsRenamed({"x": "x2", "y": "y2"})
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    out = a.join(b, ["gx", "gy"]).select("id", "other", d.alias("d"))
    return out.where(F.col("d") < radius) if strict else out.where(F.col("d") <= radius)


def outside_radius(points: DataFrame, excluded: DataFrame, radius: float) -> DataFrame:
    """Points farther than the radius from every excluded point. Which points are close is
    settled per cell (left semi), so no pairs are made."""
    a = _cells(points, radius, False)
    b = _cells(excluded.select("x", "y"), radius, True).withColumnsRenamed({"x": "x2", "y": "y2", "gx": "hx", "gy": "hy"})
    near = (F.col("gx") == F.col("hx")) & (F.col("gy") == F.col("hy")) & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= radius)
    return a.join(b, near, "left_anti").drop("gx", "gy")


#: Others in one cell beyond which nearer ones are looked for first, and the most grids.
DENSE, GRIDS = 32, 40


def _real(points: DataFrame) -> DataFrame:
    """Points whose place is finite: no other point is at a distance from."""
    return points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))


def _boxes(others: DataFrame, width: float) -> DataFrame:
    """Cells that hold others, with their number and the box around them."""
    sides = [f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))]
    return _cells(others, width, False).groupBy("gx", "gy").agg(F.count("*").alias("n"), *sides)


def _beyond(points: DataFrame, others: DataFrame, widths: list[float]) -> DataFrame:
    """``id, b``: the nearest other within the greatest width, of points that may have many others
    around. From the nine cells around a point on, cells of many others are cut in four. Only
    cells remain that can hold the nearest: no farther than the far side of any."""
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near, far = F.col("near"), F.col("far")
    open_ = _cells(points.select("id", "x", "y"), widths[0], False).withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    open_ = open_.select("id", "x", "y", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"), F.lit(widths[0]).alias("most"))
    own, found = Window.partitionBy("id"), None
    for level, width in enumerate(widths):
        gap = lambda c: F.greatest(F.col(f"low{c}") - F.col(c), F.col(c) - F.col(f"high{c}"), F.lit(0.0))
        reach = lambda c: F.greatest(F.col(f"high{c}") - F.col(c), F.col(c) - F.col(f"low{c}"))
        met = open_.join(_boxes(others, width), ["gx", "gy"])
        met = met.withColumns({"near": F.hypot(gap("x"), gap("y")), "far": F.hypot(reach("x"), reach("y"))}).where(near <= F.col("most") * (1 + 1e-9))
        met = met.withColumn("most", F.least("most", F.min(far).over(own))).where(near <= F.col("most") * (1 + 1e-9))
        met = kept(met.select("id", "x", "y", "gx", "gy", "most", "n"))
        small = F.col("n") <= DENSE if level + 1 < len(widths) else F.lit(True)
        b = _cells(others.select(F.col("id").alias("other"), "x", "y"), width, False).withColumnsRenamed({"x": "x2", "y": "y2"})
        d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
        each = met.where(small).join(b, ["gx", "gy"]).select("id", "other", d.alias("d")).where(F.col("d") <= widths[0])
        best = each.groupBy("id").agg(F.min(F.struct("d", "other")).alias("b"))
        found = best if found is None else found.unionByName(best)
        open_ = met.where(~small)
        if level + 1 == len(widths) or open_.isEmpty():
            return found.groupBy("id").agg(F.min("b").alias("b"))
        half = F.array(F.lit(0), F.lit(1))
        open_ = open_.drop("n").withColumn("dx", F.explode(half)).withColumn("dy", F.explode(half))
        open_ = open_.withColumns({"gx": F.col("gx") * 2 + F.col("dx"), "gy": F.col("gy") * 2 + F.col("dy")}).drop("dx", "dy")


def nearest_within(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """``id, other, d``: the nearest other point within the radius (the lower id on ties), null
    if there is none. Of others in one place only the lowest id counts. The grid is made finer
    until no cell holds many others: most points find one within its width among few. The others
    go from the wide grid down to cells of few that can hold the nearest (``_beyond``), so pairs
    grow with the points, not with how many others are around each."""
    others, widths = kept(_real(others).groupBy("x", "y").agg(F.min("id").alias("id"))), [radius]
    reach = max(others.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0.0, radius)
    while len(widths) < GRIDS and reach / widths[-1] < 2**50 and (_boxes(others, widths[-1]).agg(F.max("n")).first()[0] or 0) > DENSE:
        widths.append(widths[-1] / 2)
    best = pairs_within(points, others, widths[-1]).groupBy("id").agg(F.min(F.struct("d", "other")).alias("b"))
    if len(widths) > 1:
        best = kept(best)
        left = points.where((F.abs("x") <= reach + 2 * radius) & (F.abs("y") <= reach + 2 * radius)).join(best, "id", "left_anti")
        best = best.unionByName(_beyond(left, others, widths))
    return points.select("id").join(best, "id", "left").select("id", F.col("b.other").alias("other"), F.col("b.d").alias("d"))


def nearest_centre(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``points`` with ``k, d2`` of the nearest centre (``k, cx, cy``), the lower k on ties.
    Centres are a model of a few rows, held as one array beside every point."""
    held = centres.agg(F.array_sort(F.collect_list(F.struct("k", "cx", "cy"))).alias("__centres"))
    d2 = lambda c: (F.col("x") - c["cx"]) * (F.col("x") - c["cx"]) + (F.col("y") - c["cy"]) * (F.col("y") - c["cy"])
    best = F.array_min(F.transform("__centres", lambda c: F.struct(d2(c).alias("d2"), c["k"].alias("k"))))
    return points.crossJoin(F.broadcast(held)).withColumn("__best", best).select(*points.columns, F.col("__best.k").alias("k"), F.col("__best.d2").alias("d2"))


def _level_cells(points: DataFrame, radius: float, spread: bool) -> DataFrame:
    """``points (x, y, level)`` with the cell of a grid as wide as radius * 2 ** level, or with
    the nine cells around."""
    width = F.lit(radius) * F.pow(F.lit(2.0), F.col("level"))
    gx, gy = F.floor(F.col("x") / width), F.floor(F.col("y") / width)
    if not spread:
        return points.withColumns({"gx": gx, "gy": gy})
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    out = points.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    return out.withColumns({"gx": gx + F.col("dx"), "gy": gy + F.col("dy")}).drop("dx", "dy")


def nearest_of_other_fold(points: DataFrame, fold: str, radius: float) -> DataFrame:
    """``id, f, d``: for each point (``id, x, y``) the distance to the nearest one of another
    fold, null if there is no other fold. Most points find one within the radius. The others look
    for the finest grid, of widths that double, in which one of the nine cells around them holds
    another fold; the nearest point is less than three such cells away, so the nine cells of the
    grid four times as wide hold it."""
    held = kept(points.select("id", "x", "y", F.col(fold).alias("f")))
    a = _cells(held, radius, False)
    b = _cells(held.select("x", "y", "f").distinct(), radius, True).withColumnsRenamed({"x": "x2", "y": "y2", "f": "g"})
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    near = a.join(b, ["gx", "gy"]).where((F.col("f") != F.col("g")) & (d <= radius)).groupBy("id", "f").agg(F.min(d).alias("d"))
    near = kept(near)
    left = kept(held.join(near.select("id"), "id", "left_anti"))
    if left.isEmpty():
        return near
    box = held.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    most = max(1, math.ceil(math.log2(max(box.w, box.h, radius) / radius)) + 1)
    levels = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high)))
    there = _level_cells(held.withColumn("level", levels(1, most)), radius, False).select("level", "gx", "gy", F.col("f").alias("g")).distinct()
    asked = _level_cells(left.withColumn("level", levels(1, most)), radius, True)
    found = asked.join(there, ["level", "gx", "gy"]).where("f <> g").groupBy("id").agg((F.min("level") + 2).alias("level"))
    wide = _level_cells(left.join(found, "id"), radius, True)
    others = _level_cells(held.withColumn("level", levels(3, most + 2)), radius, False).select("level", "gx", "gy", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("f").alias("g"))
    far = wide.join(others, ["level", "gx", "gy"]).where("f <> g").groupBy("id", "f").agg(F.min(d).alias("d"))
    alone = left.join(found, "id", "left_anti").select("id", "f", F.lit(None).cast("double").alias("d"))
    return near.unionByName(far).unionByName(alone)


def dead_zone_report(points: DataFrame, fold: str, zone: float) -> DataFrame:
    """Per fold: rows inside and outside it, rows of it with a row of another fold nearer than
    the zone, and the least distance to one, however far."""
    near = nearest_of_other_fold(points, fold, zone)
    least = near.groupBy("f").agg(F.count_if(F.col("d") < zone).alias("n_near"), F.min("d").alias("least"))
    size = points.groupBy(F.col(fold).alias("f")).agg(F.count("*").alias("n_test"))
    total = points.count()
    out = size.join(least, "f", "left")
    return out.select(F.col("f").alias(fold), "n_test", (F.lit(total) - F.col("n_test")).alias("n_train"), F.coalesce("n_near", F.lit(0)).alias("n_near"), "least")


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Is a point inside a ring? Ray casting; an edge holds its lower end and not its upper."""
    odd = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            odd = odd + F.when(spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return odd % 2 == 1


def jitter(points: DataFrame, k: int, radius: float, seed: int) -> DataFrame:
    """k places per point: the point itself, then places drawn evenly from a disk."""
    out = points.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    r = radius * F.sqrt(uniform(seed, F.col("id"), F.col("j"), F.lit("r")))
    turn = 2 * 3.141592653589793 * uniform(seed, F.col("id"), F.col("j"), F.lit("a"))
    move = lambda f: F.when(F.col("j") == 0, 0.0).otherwise(r * f(turn))
    return out.withColumn("x", F.col("x") + move(F.cos)).withColumn("y", F.col("y") + move(F.sin))
