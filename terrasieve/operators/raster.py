"""Cleaning of grids in long form (``band, row, col, v``): gaps, masks, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import NODATA, is_close, is_valid, raster_kind, smallest_integer
from .gaps import filled_nearest, filled_smooth
from .geo import inside
from .lookup import Grid


def study_mask(cells: DataFrame, grid: Grid, ring: list[tuple[float, float]]) -> DataFrame:
    """``row, col, in_area``: whether the centre of a cell lies in a ring."""
    x, y = grid.centre(F.col("row"), F.col("col"))
    return cells.select("row", "col", inside(x, y, ring).alias("in_area"))


def cleaned(pixels: DataFrame, names: DataFrame, area: DataFrame, reach: int = 100, nodata: float = NODATA) -> DataFrame:
    """Every band filled in the way of its kind (by its name in ``names (band, name)``: means of
    the real pixels around for continuous ones, within ``reach``; the nearest value, however far,
    for classes and angles). Only cells of the area are filled and filled from; outside it all is
    NoData. Classes are rounded to whole numbers."""
    kinds = names.select("band", raster_kind(F.col("name")).alias("kind"))
    held = pixels.join(F.broadcast(kinds), "band").join(area, ["row", "col"])  # a row per band
    here = F.col("in_area")
    smooth = filled_smooth(held.where("kind = 'continuous'"), ["band", "in_area"], reach, nodata, here)
    nearest = filled_nearest(held.where("kind <> 'continuous'"), ["band", "in_area", "kind"], nodata, here)
    nearest = nearest.withColumn("v", F.when(F.col("kind") == "categorical", F.rint("v")).otherwise(F.col("v"))).drop("kind")
    return smooth.unionByName(nearest).select("band", "row", "col", F.when(here, F.col("v")).otherwise(nodata).alias("v"))


def coverage(before: DataFrame, after: DataFrame, area: DataFrame, nodata: float = NODATA, limit: float = 25.0) -> DataFrame:
    """``band, n_inside, n_missing, n_filled, percent, warn`` of the cells in the area: missing
    before, and filled after. A band warns if its missing share reaches the limit."""
    both = before.select("band", "row", "col", F.col("v").alias("a")).join(after.select("band", "row", "col", F.col("v").alias("b")), ["band", "row", "col"])
    rows = both.join(area.where("in_area"), ["row", "col"])
    lacking = ~is_valid(F.col("a"), nodata)
    out = rows.groupBy("band").agg(F.count("*").alias("n_inside"), F.count_if(lacking).alias("n_missing"), F.count_if(lacking & is_valid(F.col("b"), nodata)).alias("n_filled"))
    percent = 100 * F.col("n_missing") / F.col("n_inside")
    return out.withColumns({"percent": percent, "warn": percent >= limit})


def summary(pixels: DataFrame, nodata: float = NODATA) -> DataFrame:
    """``band, valid_count, mean, sd, least, most`` over real pixels (population deviation)."""
    v = F.when(is_valid(F.col("v"), nodata), F.col("v"))
    return pixels.groupBy("band").agg(F.count(v).alias("valid_count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"))


def storage_type(pixels: DataFrame, nodata: float = NODATA) -> DataFrame:
    """``band, kind``: the smallest integer type that holds the values of a band and NoData."""
    v = F.when(is_valid(F.col("v"), nodata), F.rint("v"))
    out = pixels.groupBy("band").agg(F.min(v).alias("low"), F.max(v).alias("high"))
    return out.select("band", smallest_integer(F.col("low"), F.col("high"), nodata).alias("kind"))


def all_close(a: Column, b: Column, atol: float = 1e-9) -> Column:
    """Do two arrays of numbers have the same length and no pair farther apart?"""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: is_close(x, y, 0.0, atol)), lambda ok: ok)


def alignment(files: DataFrame, expected_nodata: float | None = None) -> DataFrame:
    """``name, problem``: what differs between the grid of each file and that of the first by
    name (``name, crs, transform, width, height, nodata``). No row: all are aligned."""
    first = files.agg(F.min(F.struct("name", "crs", "transform", "width", "height")).alias("first"))
    held = files.join(F.broadcast(first), F.lit(True))  # one row
    checks = {
        "crs": F.col("crs").eqNullSafe(F.col("first.crs")),
        "transform": all_close(F.col("transform"), F.col("first.transform")),
        "size": (F.col("width") == F.col("first.width")) & (F.col("height") == F.col("first.height")),
    }
    if expected_nodata is not None:
        checks["nodata"] = F.col("nodata").eqNullSafe(F.lit(expected_nodata))
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return held.select("name", F.explode(F.array_compact(found)).alias("problem"))


def listed(files: DataFrame, without: str, expected: int | None = None) -> DataFrame:
    """Names of rasters, those that hold a word left out; another number of them is an error."""
    out = files.where(~F.lower("name").contains(without.lower()))
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{expected} rasters are needed, there are {n}")
    return out
