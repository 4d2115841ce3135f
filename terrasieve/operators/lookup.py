"""Points meet grids: values of all bands at a point, windows around points, whole patches.

A grid is a table of pixels ``band, row, col, v``. Points ``id, x, y`` find their cell by
arithmetic, so every lookup is an equi join on row and column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import NODATA, cell_centre, is_valid, patch_window, row_col
from .patch import band_statistics, context_mask, normalised, window_pixels


@dataclass(frozen=True)
class Grid:
    """Where a grid lies: its upper left corner, the size of its cells, its rows and columns."""

    left: float
    top: float
    width: float
    height: float
    rows: int
    cols: int

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        return row_col(x, y, self.left, self.top, self.width, self.height)

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return cell_centre(row, col, self.left, self.top, self.width, self.height)

    def in_bounds(self, x: Column, y: Column) -> Column:
        """Inside the bounding box, both ends included."""
        return x.between(self.left, self.left + self.cols * self.width) & y.between(self.top - self.rows * self.height, self.top)


def with_cells(points: DataFrame, grid: Grid) -> DataFrame:
    row, col = grid.cell(F.col("x"), F.col("y"))
    return points.withColumns({"row": row, "col": col})


def wide_pixels(pixels: DataFrame, bands: list[int]) -> DataFrame:
    """``row, col, f<band>...``: all bands of a pixel side by side."""
    each = [F.max(F.when(F.col("band") == b, F.col("v"))).alias(f"f{b}") for b in bands]
    return pixels.groupBy("row", "col").agg(*each)


def factor_values(points: DataFrame, pixels: DataFrame, grid: Grid, bands: list[int]) -> DataFrame:
    """``points`` with row, column and the value of each band there; null outside the grid."""
    return with_cells(points, grid).join(wide_pixels(pixels, bands), ["row", "col"], "left")


def with_valid_factors(points: DataFrame, pixels: DataFrame, grid: Grid, bands: list[int], nodata: float = NODATA) -> DataFrame:
    """The points at which every band is real, with their values."""
    valid = F.lit(True)
    for b in bands:
        valid = valid & is_valid(F.col(f"f{b}"), nodata)
    return with_cells(points, grid).join(wide_pixels(pixels, bands).where(valid), ["row", "col"])


def windows_of(points: DataFrame, grid: Grid, size: int) -> DataFrame:
    """``points`` with row, column, the window of an even size around them, and whether it lies
    in the grid as a whole."""
    out = with_cells(points, grid)
    out = out.withColumns(patch_window(F.col("row"), F.col("col"), size))
    inside = (F.col("row_start") >= 0) & (F.col("col_start") >= 0) & (F.col("row_stop") <= grid.rows) & (F.col("col_stop") <= grid.cols)
    return out.withColumn("inside", inside)


def patches(windows: DataFrame, pixels: DataFrame, bands: list[int], nodata: float = NODATA) -> DataFrame:
    """``id, band, row, col, v`` of each window, rows and columns counted from its corner; what
    lies outside the grid has the NoData value."""
    every = windows.withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
    cells = window_pixels(every, pixels, nodata)
    return cells.select("id", "band", F.col("r").alias("row"), F.col("c").alias("col"), "v")


def patch_index(points: DataFrame, pixels: DataFrame, grid: Grid, size: int, bands: list[int], most_nodata: float = 0.0) -> DataFrame:
    """``id, row, col, inside, nodata_ratio, valid_patch``: a patch is valid if its window lies in
    the grid and no more than the given share of its pixels lacks data in any band."""
    held = windows_of(points, grid, size)
    mask = context_mask(patches(held, pixels, bands))
    ratio = mask.groupBy("id").agg((1 - F.avg("m")).alias("nodata_ratio"))
    out = held.select("id", "row", "col", "inside").join(ratio, "id")
    return out.withColumn("valid_patch", F.col("inside") & (F.col("nodata_ratio") <= most_nodata))


def patch_items(points: DataFrame, pixels: DataFrame, grid: Grid, size: int, bands: list[int]) -> DataFrame:
    """What a model is given: the normalised bands of the patch around each point whose centre
    is real, and the mask as a last band. Statistics are those of all these patches."""
    cut = patches(windows_of(points, grid, size), pixels, bands)
    mask = context_mask(cut)
    centre = mask.where((F.col("row") == size // 2) & (F.col("col") == size // 2) & (F.col("m") == 1)).select("id")
    cut, mask = cut.join(centre, "id", "left_semi"), mask.join(centre, "id", "left_semi")
    return normalised(cut, mask, band_statistics(cut, mask))


def two_views(points: DataFrame, pixels: DataFrame, grid: Grid, small: int, large: int, bands: list[int]) -> DataFrame:
    """``id, small_mean, large_mean, small_real, large_real``: means over real pixels, and how
    many there are, of two odd windows around the same cell."""
    held = with_cells(points, grid).select("id", F.col("row").alias("at"), F.col("col").alias("across"))
    half = large // 2
    span = {"row_start": F.col("at") - half, "row_stop": F.col("at") + half + 1, "col_start": F.col("across") - half, "col_stop": F.col("across") + half + 1}
    cut = patches(held.withColumns(span), pixels, bands)
    near = (F.abs(F.col("row") - half) <= small // 2) & (F.abs(F.col("col") - half) <= small // 2)
    real = is_valid(F.col("v"))
    return cut.groupBy("id").agg(
        F.avg(F.when(near & real, F.col("v"))).alias("small_mean"),
        F.avg(F.when(real, F.col("v"))).alias("large_mean"),
        F.count_if(near & real).alias("small_real"),
        F.count_if(real).alias("large_real"),
    )


def same_pixels(left: DataFrame, right: DataFrame) -> DataFrame:
    """``id, n, most, missing``: of patches on both sides the greatest difference, and pixels
    that one side lacks: a cache is exact if both are 0."""
    a = left.select("id", "band", "row", "col", F.col("v").alias("a"), F.lit(1).alias("ia"))
    b = right.select("id", "band", "row", "col", F.col("v").alias("b"), F.lit(1).alias("ib"))
    both = a.join(b, ["id", "band", "row", "col"], "full")
    missing = F.count_if(F.col("ia").isNull() | F.col("ib").isNull())
    return both.groupBy("id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("most"), missing.alias("missing"))
