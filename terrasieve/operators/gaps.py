"""Gaps of grids in long form filled from real pixels however far away, in rows linear in pixels.

A grid is cut into blocks of whole rows. What lies above and below a block counts by the next real
pixel of each column only, so a block with gaps gets its own real pixels and two more per column,
found from the first and last real pixel that each column has in each block. In a block the
nearest real pixel of each column gives every row a list of distances, and the least of the sums
of squares moves to the right with the column asked for: the rows of a block halve their gaps
together, level by level, so a block costs its cells times the logarithm of its width.

Cells that a table doesn't have are neither gaps nor real. Null, NaN, infinite and NoData values
are gaps. Gaps without any real pixel in reach keep NoData.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.scalars import NODATA, is_valid

#: Cells that a block, and a task, should have.
BLOCK_CELLS = 1 << 20
#: Rows, columns and values of real pixels, rows and columns of gaps -> values (NaN: none).
Fill = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def row_minima(row: np.ndarray, x: np.ndarray, w: np.ndarray, asked_row: np.ndarray, asked_x: np.ndarray, scale: int = 1, before: str | None = None) -> np.ndarray:
    """For each place asked for the candidate of its row with the least (distance in x)^2 * scale
    + w, the first of equal ones; -1 if there is none. ``before``: only candidates to the left of
    the place ("strictly", or "or at" it), and the last of equal ones. Candidates and places are
    sorted by row and x."""
    width = int(max(x.max(initial=0), asked_x.max(initial=0))) + 1
    key = row * width + x
    start = np.searchsorted(row, asked_row)
    if before is None:
        stop = np.searchsorted(row, asked_row, "right")
    else:
        stop = np.searchsorted(key, asked_row * width + asked_x, "right" if before == "or at" else "left")
    best = np.full(len(asked_row), -1, np.int64)
    able = np.flatnonzero(stop > start)
    if not len(able):
        return best
    at, ax, stop = asked_row[able], asked_x[able], stop[able]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    low, high = first, np.append(first[1:], len(at)) - 1
    left, right = start[able][first], stop[high] - 1
    found = np.empty(len(at), np.int64)
    while len(low):
        mid = (low + high) // 2
        n = np.minimum(right, stop[mid] - 1) - left + 1
        edge = np.cumsum(n) - n
        j = np.arange(int(n.sum())) - np.repeat(edge - left, n)
        cost = (np.repeat(ax[mid], n) - x[j]) ** 2 * scale + w[j]
        least = cost == np.repeat(np.minimum.reduceat(cost, edge), n)
        pick = np.minimum.reduceat(np.where(least, j, len(x)), edge) if before is None else np.maximum.reduceat(np.where(least, j, -1), edge)
        found[mid] = pick
        a, b = low < mid, mid < high
        low, high, left, right = np.append(low[a], mid[b] + 1), np.append(mid[a] - 1, high[b]), np.append(left[a], pick[b]), np.append(pick[a], right[b])
    best[able] = found
    return best


def _columns(r: np.ndarray, c: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of real pixels by column and row, their columns, and for each of the rows and columns
    the first pixel of the column beyond the row, and where the column's pixels start and end."""
    order = np.lexsort((r, c))
    cols, start = np.unique(c[order], return_index=True)
    end = np.append(start[1:], len(c))
    tall = int(max(r.max(), rows.max())) + 2
    key = np.repeat(np.arange(len(cols)), end - start) * tall + r[order]
    beyond = np.searchsorted(key, (np.arange(len(cols)) * tall)[None, :] + rows[:, None], "right")
    return order, cols, beyond, start, end


def nearest_value(r: np.ndarray, c: np.ndarray, v: np.ndarray, gap_r: np.ndarray, gap_c: np.ndarray) -> np.ndarray:
    """The value of the real pixel nearest to each gap, by (distance, row, column). Gaps are
    sorted by row and column."""
    rows, at = np.unique(gap_r, return_inverse=True)
    order, cols, beyond, start, end = _columns(r, c, rows)
    up, down = np.maximum(beyond - 1, start), np.minimum(beyond, end - 1)  # one of them at least
    r = r[order]
    far_up, far_down = np.abs(rows[:, None] - r[up]), np.abs(r[down] - rows[:, None])
    pixel = np.where(far_up <= far_down, up, down)
    scale = int(r.max()) + 1
    w = (np.minimum(far_up, far_down) ** 2 * scale + r[pixel]).ravel()
    best = row_minima(np.repeat(np.arange(len(rows)), len(cols)), np.tile(cols, len(rows)), w, at, gap_c, scale)
    return v[order][pixel.ravel()[best]]


def quadrant_mean(reach: int) -> Fill:
    """The mean of the nearest real pixel of each quadrant within reach, weighted by 1 / distance.
    Upper quadrants hold the gap's row, left ones its column."""

    def fill(r: np.ndarray, c: np.ndarray, v: np.ndarray, gap_r: np.ndarray, gap_c: np.ndarray) -> np.ndarray:
        rows, at = np.unique(gap_r, return_inverse=True)
        order, cols, beyond, start, end = _columns(r, c, rows)
        r, v = r[order], v[order]
        total, weight = np.zeros(len(at)), np.zeros(len(at))
        width = int(max(cols.max(), gap_c.max()))
        for pixel, held in ((beyond - 1, beyond > start), (beyond, beyond < end)):
            pixel = np.clip(pixel, start, end - 1)
            far = np.abs(rows[:, None] - r[pixel])
            i, j = np.nonzero(held & (far <= reach))
            own, w = pixel[i, j], far[i, j] ** 2
            for before, x, asked in (("or at", cols[j], gap_c), ("strictly", width - cols[j], width - gap_c)):
                turn, ask = np.lexsort((x, i)), np.lexsort((asked, at))
                best = row_minima(i[turn], x[turn], w[turn], at[ask], asked[ask], 1, before)
                hit = ask[best >= 0]
                found = turn[best[best >= 0]]
                d2 = (asked[hit] - x[found]) ** 2 + w[found]
                near = d2 <= reach * reach
                hit, found, inverse = hit[near], found[near], 1 / np.sqrt(d2[near])
                total[hit] += v[own[found]] * inverse
                weight[hit] += inverse
        return np.where(weight > 0, total / np.where(weight > 0, weight, 1), np.nan)

    return fill


def _dealt(held: DataFrame, keys: list[str], height: int) -> DataFrame:
    """``keys, block, row, col, v, gap`` of the gaps and of the real pixels that count for them."""
    held = held.withColumn("block", F.floor(F.col("row") / height).cast("long"))
    gaps, real = held.where("gap"), held.where("real")
    wanted = gaps.select(*keys, "block").distinct()
    pixel = F.struct("row", "v")
    ends = real.groupBy(*keys, "col", "block").agg(F.min(pixel).alias("first"), F.max(pixel).alias("last"))
    asked_for = wanted.withColumnsRenamed({k: f"__{k}" for k in [*keys, "block"]})
    same = lambda names: [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in names]
    none = F.lit(None).cast(ends.schema["first"].dataType)
    asked = real.select(*keys, "col").distinct().join(asked_for, same(keys))
    asked = asked.select(*keys, "col", F.col("__block").alias("block"), none.alias("first"), none.alias("last"), F.lit(True).alias("asked"))
    both = asked.unionByName(ends.withColumn("asked", F.lit(False)))
    down = Window.partitionBy(*keys, "col").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy(*keys, "col").orderBy(-F.col("block")).rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({"above": F.last("last", ignorenulls=True).over(down), "below": F.last("first", ignorenulls=True).over(up)}).where("asked")
    carried = both.select(*keys, "block", "col", F.explode(F.array_compact(F.array("above", "below"))).alias("p"))
    own = real.join(asked_for, same([*keys, "block"]), "left_semi")
    out = [gaps.select(*keys, "block", "row", "col", F.lit(0.0).alias("v"), F.lit(True).alias("gap"))]
    out.append(own.select(*keys, "block", "row", "col", "v", F.lit(False).alias("gap")))
    out.append(carried.select(*keys, "block", F.col("p.row").alias("row"), "col", F.col("p.v").alias("v"), F.lit(False).alias("gap")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def filled(pixels: DataFrame, keys: list[str], fill: Fill, nodata: float = NODATA, within: Column | None = None) -> DataFrame:
    """``pixels (keys, row, col, v)`` with its gaps filled; ``keys`` tell grids apart. With
    ``within`` only cells for which it holds are filled, and only from such cells; others are
    as they were."""
    here = F.lit(True) if within is None else F.coalesce(within, F.lit(False))
    names = [*keys, "row", "col"]
    row, col = F.col("row").cast("long"), F.col("col").cast("long")
    known = is_valid(F.col("v"), nodata)
    held = pixels.select(*keys, row.alias("row"), col.alias("col"), F.col("v").cast("double").alias("v"), (here & ~known).alias("gap"), (here & known).alias("real"))
    size = held.agg(F.count("*").alias("n"), F.min("row").alias("r"), F.min("col").alias("c"), F.max("col").alias("d")).first()
    if not size.n:
        return pixels.select(*names, F.col("v").cast("double").alias("v"))
    top, left = size.r, size.c  # numpy counts from 0
    dealt = _dealt(held, keys, max(1, BLOCK_CELLS // (size.d - size.c + 1)))
    tasks = max(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size.n // BLOCK_CELLS))

    def run(some: pa.Table) -> pa.Table:
        gap, v = some["gap"].to_numpy(zero_copy_only=False).astype(bool), some["v"].to_numpy()
        row, column = some["row"].to_numpy() - top, some["col"].to_numpy() - left
        # Keys are told apart by number; they never pass through floats.
        codes = [some[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in [*keys, "block"]]
        order = np.lexsort((column, row, ~gap, *codes))
        codes = np.stack(codes)[:, order]
        start = np.flatnonzero(np.append(True, (codes[:, 1:] != codes[:, :-1]).any(axis=0))) if len(order) else np.zeros(0, np.int64)
        at, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for low, high in zip(start, np.append(start[1:], len(order)), strict=True):
            own = order[low:high]
            gaps, real = own[gap[own]], own[~gap[own]]
            if len(gaps):
                found = fill(row[real], column[real], v[real], row[gaps], column[gaps]) if len(real) else np.full(len(gaps), np.nan)
                at.append(gaps), values.append(np.where(np.isnan(found), nodata, found))
        return some.select(names).take(pa.array(np.concatenate(at))).append_column("v", pa.array(np.concatenate(values)))

    schema = StructType([*[f for f in held.schema.fields if f.name in keys], StructField("row", LongType()), StructField("col", LongType()), StructField("v", DoubleType())])
    found = dealt.groupBy(F.pmod(F.xxhash64(*keys, "block"), F.lit(tasks)).alias("task")).applyInArrow(run, schema)
    return held.where("not gap").select(*names, "v").unionByName(found)


def filled_nearest(pixels: DataFrame, keys: list[str], nodata: float = NODATA, within: Column | None = None) -> DataFrame:
    """Gaps take the value of the nearest real pixel of their grid, by (distance, row, col): the
    way of classes and of angles, which have no means."""
    return filled(pixels, keys, nearest_value, nodata, within)


def filled_smooth(pixels: DataFrame, keys: list[str], reach: int = 100, nodata: float = NODATA, within: Column | None = None) -> DataFrame:
    """Gaps take the mean of the nearest real pixel of each quadrant within ``reach`` cells,
    weighted by 1 / distance."""
    return filled(pixels, keys, quadrant_mean(reach), nodata, within)
