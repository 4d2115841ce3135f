"""Pixels and patches in long form: ``id, band, row, col, v``. Every transform is arithmetic on
the place of a pixel or a join on it, so patches of any size stay spread over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import NODATA, is_valid, uniform
from .sampling import ranked


def window_pixels(windows: DataFrame, pixels: DataFrame, nodata: float = NODATA) -> DataFrame:
    """``id, band, row, col, r, c, v`` for every cell of each window (``id, band, row_start,
    row_stop, col_start, col_stop``); cells outside the raster have the NoData value."""
    cells = windows.select("id", "band", "row_start", "col_start", F.explode(F.sequence(F.col("row_start"), F.col("row_stop") - 1)).alias("row"), "col_stop")
    cells = cells.select("id", "band", "row_start", "col_start", "row", F.explode(F.sequence(F.col("col_start"), F.col("col_stop") - 1)).alias("col"))
    out = cells.join(pixels.select("band", "row", "col", "v"), ["band", "row", "col"], "left")
    return out.select("id", "band", "row", "col", (F.col("row") - F.col("row_start")).alias("r"), (F.col("col") - F.col("col_start")).alias("c"), F.coalesce("v", F.lit(nodata)).alias("v"))


def context_mask(patches: DataFrame, nodata: float = NODATA) -> DataFrame:
    """``id, row, col, m``: 1 where the pixel is real in every band."""
    return patches.groupBy("id", "row", "col").agg(F.min(is_valid(F.col("v"), nodata).cast("int")).alias("m"))


def centre_valid(mask: DataFrame, size: int) -> DataFrame:
    """Ids whose centre pixel is real."""
    return mask.where((F.col("row") == size // 2) & (F.col("col") == size // 2) & (F.col("m") == 1)).select("id")


def band_statistics(patches: DataFrame, mask: DataFrame) -> DataFrame:
    """``band, n, mean, sd`` over real pixels; the variance is at least 1e-12."""
    rows = patches.join(mask, ["id", "row", "col"]).where("m = 1")
    sums = rows.groupBy("band").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("v")).alias("sq"))
    return sums.select("band", "n", "mean", F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(1e-12))).alias("sd"))


def normalised(patches: DataFrame, mask: DataFrame, stats: DataFrame) -> DataFrame:
    """(v - mean) / (sd + 1e-6) where real and 0 elsewhere, and the mask as a further band."""
    bands = F.broadcast(stats.select("band", "mean", "sd"))  # a row per band
    out = patches.join(mask, ["id", "row", "col"]).join(bands, "band")
    value = F.when(F.col("m") == 1, (F.col("v") - F.col("mean")) / (F.col("sd") + 1e-6)).otherwise(0.0)
    last = F.broadcast(stats.agg((F.max("band") + 1).alias("band")))
    return out.select("id", "band", "row", "col", value.alias("v")).unionByName(mask.crossJoin(last).select("id", "band", "row", "col", F.col("m").cast("double").alias("v")))


def rotated(patches: DataFrame, quarter: Column, size: int) -> DataFrame:
    """Turned counter-clockwise by quarters of a full turn (0 to 3)."""
    r, c, last = F.col("row"), F.col("col"), size - 1
    row = F.when(quarter == 1, last - c).when(quarter == 2, last - r).when(quarter == 3, c).otherwise(r)
    col = F.when(quarter == 1, r).when(quarter == 2, last - c).when(quarter == 3, last - r).otherwise(c)
    return patches.withColumns({"row": row, "col": col})


def tiles_permuted(patches: DataFrame, order: list[int], grid: int, size: int) -> DataFrame:
    """Tile p of the result is tile order[p] of the patch."""
    if sorted(order) != list(range(grid * grid)) or size % grid:
        raise ValueError("a permutation of all tiles of a grid that divides the patch is needed")
    t = size // grid
    target = F.array(*[F.lit(order.index(i)) for i in range(grid * grid)])  # where a tile goes
    tile = (F.floor(F.col("row") / t) * grid + F.floor(F.col("col") / t)).cast("int")
    to = F.get(target, tile)
    return patches.withColumns({"row": (F.floor(to / grid) * t + F.col("row") % t).cast("int"), "col": ((to % grid) * t + F.col("col") % t).cast("int")})


def strip_sizes(height: int, n: int) -> list[int]:
    return [height // n + (i < height % n) for i in range(n)]


def strips_permuted(patches: DataFrame, order: list[int], height: int) -> DataFrame:
    """Strips of unequal heights, laid down in the given order."""
    sizes = strip_sizes(height, len(order))
    start = [sum(sizes[:i]) for i in range(len(order))]
    row, at = F.col("row"), 0
    for s in order:
        row = F.when(F.col("row").between(start[s], start[s] + sizes[s] - 1), F.col("row") - start[s] + at).otherwise(row)
        at += sizes[s]
    return patches.withColumn("row", row.cast("int"))


def block_mask(ids: DataFrame, size: int, block: int, ratio: float, seed: int) -> DataFrame:
    """``id, block, masked``: the rounded share of blocks, one at least, drawn for each id."""
    per = (size // block) ** 2
    n = max(1, round(ratio * per))
    every = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("block"))
    return ranked(every, ["id"], seed, "block", ("id",)).select("id", "block", (F.col("rn") <= n).cast("int").alias("masked"))


def masked_error(patches: DataFrame, rebuilt: Column, blocks: DataFrame, size: int, block: int) -> DataFrame:
    """``id, mse`` over masked pixels and all bands; the denominator is 1 at least."""
    at = (F.floor(F.col("row") / block) * (size // block) + F.floor(F.col("col") / block)).cast("int")
    rows = patches.withColumn("block", at).join(blocks, ["id", "block"])
    d = F.col("v") - rebuilt
    return rows.groupBy("id").agg((F.sum(d * d * F.col("masked")) / F.greatest(F.sum("masked"), F.lit(1))).alias("mse"))


def band_masked(patches: DataFrame, band: int) -> DataFrame:
    """``patches`` with one band set to 0 and its values kept in ``target``."""
    own = F.col("band") == band
    return patches.withColumn("target", F.when(own, F.col("v"))).withColumn("v", F.when(own, 0.0).otherwise(F.col("v")))


def band_error(masked: DataFrame, rebuilt: Column, band: int) -> DataFrame:
    """``id, mse`` of a rebuilt band against its ``target`` (see ``band_masked``)."""
    d = rebuilt - F.col("target")
    return masked.where(F.col("band") == band).groupBy("id").agg(F.avg(d * d).alias("mse"))


def panels(patches: DataFrame, rebuilt: Column, blocks: DataFrame, size: int, block: int) -> DataFrame:
    """``id, band, row, col, shown, error``: what a model saw, and how far off it was."""
    at = (F.floor(F.col("row") / block) * (size // block) + F.floor(F.col("col") / block)).cast("int")
    rows = patches.withColumn("block", at).join(blocks, ["id", "block"])
    return rows.select("id", "band", "row", "col", (F.col("v") * (1 - F.col("masked"))).alias("shown"), F.abs(rebuilt - F.col("v")).alias("error"))


def flipped(patches: DataFrame, size: int, across: bool) -> DataFrame:
    name = "col" if across else "row"
    return patches.withColumn(name, size - 1 - F.col(name))


def crop_resized(patches: DataFrame, top: int, left: int, side: int, size: int) -> DataFrame:
    """A square of ``side`` pixels brought to ``size`` pixels, corners on corners, by the four
    pixels around each place. Each pixel goes to the places that it weighs in: an equi join with
    a table of weights, whose size is that of a patch."""
    step = (side - 1) / (size - 1)

    def axis(start: int) -> list[list[tuple[int, float]]]:
        out = []
        for i in range(size):
            at = start + i * step
            low = min(int(at), start + side - 2)
            out.append([(low, 1 - (at - low)), (low + 1, at - low)])
        return out

    ys, xs = axis(top), axis(left)
    rows = [(y, x, r, c, wy * wx) for r in range(size) for c in range(size) for y, wy in ys[r] for x, wx in xs[c]]
    weights = patches.sparkSession.createDataFrame(rows, "row long, col long, r long, c long, w double")
    out = patches.join(F.broadcast(weights), ["row", "col"])  # four rows for each pixel of one patch
    return out.groupBy("id", "band", F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def noised(patches: DataFrame, sd: float, drop: float, seed: int) -> DataFrame:
    """Normal noise on every pixel, and whole bands of a patch set to 0 with a probability; both
    drawn by digest, so that a view is the same in every run."""
    key = [F.col(c) for c in ("id", "band", "row", "col")]
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, *key, F.lit("a"))))
    noise = sd * radius * F.cos(2 * 3.141592653589793 * uniform(seed, *key, F.lit("b")))
    gone = uniform(seed, F.col("id"), F.col("band"), F.lit("drop")) < drop
    return patches.withColumn("v", F.when(gone, 0.0).otherwise(F.col("v") + noise))


def view_difference(left: DataFrame, right: DataFrame, least: float = 1e-6) -> DataFrame:
    """``id, mean_difference, differ``: do two views of a patch differ at all?"""
    other = right.select("id", "band", "row", "col", F.col("v").alias("w"))
    d = left.join(other, ["id", "band", "row", "col"]).groupBy("id").agg(F.avg(F.abs(F.col("v") - F.col("w"))).alias("mean_difference"))
    return d.withColumn("differ", F.col("mean_difference") > least)


def contrastive_loss(pairs: DataFrame, temperature: float = 0.2) -> DataFrame:
    """NT-Xent of batches (``batch, pair, side, z``): the loss of each batch. Vectors are brought
    to unit length; a vector meets all others of its batch, whose size is a parameter of
    training and does not grow with the data."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.greatest(F.sqrt(dot(F.col("z"), F.col("z"))), F.lit(1e-12))
    unit = pairs.withColumn("z", F.transform("z", lambda x: x / norm))
    other = unit.select("batch", F.col("pair").alias("pair2"), F.col("side").alias("side2"), F.col("z").alias("z2"))
    sims = unit.join(other, "batch").where("pair <> pair2 or side <> side2").select("batch", "pair", "side", (F.col("pair") == F.col("pair2")).alias("same"), (dot(F.col("z"), F.col("z2")) / temperature).alias("s"))
    each = sims.groupBy("batch", "pair", "side").agg((F.log(F.sum(F.exp("s"))) - F.max(F.when(F.col("same"), F.col("s")))).alias("loss"))
    return each.groupBy("batch").agg(F.avg("loss").alias("loss"))


def nodata_ratio(patches: DataFrame, nodata: float = NODATA) -> DataFrame:
    return patches.groupBy("id").agg(F.avg((F.col("v") == nodata).cast("double")).alias("ratio"))
