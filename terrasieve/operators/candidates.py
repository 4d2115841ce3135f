"""Where samples may come from: places drawn in bounds, centres of patches, cells of a pool.

All draws are digests of seed and number, so they are the same in every run and need no state;
a quota is a filter on the place in the order of draws.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_valid, uniform
from .lookup import Grid
from .running import running_totals
from .sampling import draw_key, ranked, share_key
from .scratch import kept


def random_places(ids: DataFrame, seed: int, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """``id, x, y``: a place drawn evenly from a box for each id."""
    i = F.col("id")
    x = F.lit(left) + F.lit(right - left) * uniform(seed, i, F.lit("x"))
    y = F.lit(bottom) + F.lit(top - bottom) * uniform(seed, i, F.lit("y"))
    return ids.select("id", x.alias("x"), y.alias("y"))


def random_points(spark: SparkSession, n: int, seed: int, left: float, bottom: float, right: float, top: float, start: int = 0) -> DataFrame:
    """``id, x, y``: n places drawn evenly from a box, numbered from ``start``."""
    return random_places(spark.range(start, start + n), seed, left, bottom, right, top)


class QuotaNotMet(RuntimeError):
    """Too few draws were accepted within the attempts."""


def accepted_points(
    spark: SparkSession,
    box: tuple[float, float, float, float],
    accept: Callable[[DataFrame], DataFrame],
    quota: int,
    batch: int,
    most_attempts: int,
    seed: int,
    partial: bool = False,
) -> DataFrame:
    """The first ``quota`` places, in the order of draws, that ``accept`` lets pass: it gets draws
    (``id, x, y``) and returns some of them, with what columns it likes besides. ``rn`` counts
    them from 1, ``candidate_id`` is ``U_000001`` and so on.

    Draws are made in batches, each twice as large as the one before, until the quota is met; how
    they are cut does not change what is drawn. Fewer after ``most_attempts`` draws are an error,
    or with ``partial`` a shorter result (but none at all is an error still).
    """
    held, found, at = None, 0, 0
    while found < quota and at < most_attempts:
        n = min(batch, most_attempts - at)
        own = kept(accept(random_points(spark, n, seed, *box, start=at)))
        held = own if held is None else held.unionByName(own)
        found, at, batch = found + own.count(), at + n, 2 * batch
    if held is None or found < (1 if partial else quota):
        raise QuotaNotMet(f"{found} of {quota} places were found in {at} draws")
    out = running_totals(held, [], "id", [], {"rn": F.lit(1)}, wanted=F.col("__before_rn") < quota).where(F.col("rn") <= quota)
    return out.withColumn("candidate_id", F.format_string("U_%06d", "rn"))


def first_accepted(draws: DataFrame, accepted: DataFrame, quota: int) -> DataFrame:
    """Of draws by ``id`` the first ``quota`` that were accepted (``id``), with their place
    ``rn`` among them. Fewer are an error of the caller's: draw more."""
    kept = draws.join(accepted.select("id"), "id", "left_semi")
    return running_totals(kept, [], "id", [], {"rn": F.lit(1)}, wanted=F.col("__before_rn") < quota).where(F.col("rn") <= quota)


def window_totals(cells: DataFrame, value: str, size: int, rows: int, cols: int) -> DataFrame:
    """``cells (row, col, ...)`` whose window of an even size lies in the grid, with the ``total``
    of a value over it. Totals up to a cell, along rows and then along columns, make every window
    four numbers, two on each axis: rows stay linear in cells, whatever the size. The cells have to
    be all of the grid, each once."""
    half = size // 2
    at = F.coalesce(F.col(value), F.lit(0)).cast("long")
    for axis, other, end in (("col", "row", cols), ("row", "col", rows)):
        order = Window.partitionBy(other).orderBy(axis)
        cells = cells.withColumn("__upto", F.sum(at).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        span = F.lead("__upto", half - 1).over(order) - F.coalesce(F.lag("__upto", half + 1).over(order), F.lit(0))
        cells = cells.withColumn("total", span).where((F.col(axis) >= half) & (F.col(axis) + half <= end)).drop("__upto")
        at = F.col("total")
    return cells


#: What a cell lacks: 1 if any band is not real there, 1 if none is, or the number that are not.
LACKING = ("any", "all", "share")


def interior_centres(pixels: DataFrame, grid: Grid, size: int, bands: list[int], most_nodata: float, n: int, seed: int, lacking: str = "any", real_centre: bool = True) -> DataFrame:
    """``row, col, ratio``: n cells (fewer only if there are no more), drawn without repeats, whose
    window of an even size lies in the grid and lacks data in the given share of it at most, and
    that are real in every band themselves. Cells count as lacking if any band does, if all bands
    do, or by the share of bands that do."""
    if lacking not in LACKING or size <= 0 or size % 2:
        raise ValueError(f"an even size and one of {LACKING} are needed")
    real = pixels.where(F.col("band").isin(bands)).groupBy("row", "col").agg(F.count_if(is_valid(F.col("v"))).alias("n"))
    every = pixels.sparkSession.range(grid.rows * grid.cols).select((F.floor(F.col("id") / grid.cols)).alias("row"), (F.col("id") % grid.cols).alias("col"))
    held = F.coalesce(F.col("n"), F.lit(0))
    bad = {"any": (held < len(bands)).cast("int"), "all": (held == 0).cast("int"), "share": F.lit(len(bands)) - held}[lacking]
    cells = every.join(real, ["row", "col"], "left").select("row", "col", bad.alias("bad"), (held == len(bands)).alias("real"))
    ratio = F.col("total") / F.lit(float(size * size * (len(bands) if lacking == "share" else 1)))
    found = window_totals(cells, "bad", size, grid.rows, grid.cols).withColumn("ratio", ratio).where(F.col("ratio") <= most_nodata)
    found = found.where("real") if real_centre else found
    found = found.select("row", "col", "ratio", (F.col("row") * grid.cols + F.col("col")).alias("id"))
    out = ranked(found, [], seed, "id", wanted=F.col("__before_rn") < n)
    return out.where(F.col("rn") <= n).select("row", "col", "ratio")


def drawn_with_replacement(pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``draw`` and the rows of ``pool``: n draws, each of any row. Rows are numbered in digest
    order, draws are numbers, and both meet by equi join."""
    digest = pool.withColumn("__digest", draw_key(seed, key)).withColumn("__head", share_key("__digest"))
    numbered = running_totals(digest, [], "__head", ["__digest", key], {"__at": F.lit(1)}, uniform=True).drop("__digest", "__head")
    total = pool.count()
    draws = pool.sparkSession.range(n).select(F.col("id").alias("draw"))
    draws = draws.withColumn("__at", (F.floor(uniform(seed, F.col("draw"), F.lit("pool")) * total) + 1).cast("long"))
    return draws.join(numbered, "__at").drop("__at")


def off_cells(points: DataFrame, taken: DataFrame) -> DataFrame:
    """Points (``row, col``) whose cell no row of ``taken`` sits on."""
    return points.join(taken.select("row", "col"), ["row", "col"], "left_anti")


def task_labels(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``rows`` with ``task``, a label from 0 to n - 1 drawn for each."""
    return rows.withColumn("task", F.floor(uniform(seed, F.col(key), F.lit("task")) * n).cast("int"))


def paired_draw(rows: DataFrame, fold: str, fractions: list[float], seeds: list[int], key: str, least: int = 8) -> DataFrame:
    """``seed, held_fold, fraction`` and the training rows drawn for each: of the rows outside a
    held-out fold the rounded share, ``least`` at least. The order depends on seed, fold and
    fraction only, so that all models of a comparison learn from the same rows."""
    folds = rows.select(F.col(fold).alias("held_fold")).distinct()
    jobs = folds.select("held_fold", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    jobs = jobs.select("*", F.explode(F.array(*[F.lit(f) for f in fractions])).alias("fraction"))
    every = rows.join(F.broadcast(jobs), F.col(fold) != F.col("held_fold"))  # a row per fold, seed and fraction
    strata = ["held_fold", "seed", "fraction"]
    sizes = every.groupBy(*[F.col(s).alias(f"__{s}") for s in strata]).agg(F.count("*").alias("__n"))
    want = F.greatest(F.lit(least), F.rint(F.col("__n") * F.col("fraction")))
    every = every.join(F.broadcast(sizes), [F.col(s) == F.col(f"__{s}") for s in strata]).drop(*[f"__{s}" for s in strata])
    out = ranked(every, strata, "pair", key, ("seed", "held_fold", "fraction"), wanted=F.col("__before_rn") < want)
    return out.where(F.col("rn") <= want).drop("rn", "__n")


def moved(x: Column, y: Column, radius: Column, turn: Column) -> tuple[Column, Column]:
    """A place at a distance and an angle from another."""
    return x + radius * F.cos(turn), y + radius * F.sin(turn)
