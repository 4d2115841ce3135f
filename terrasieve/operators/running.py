"""Running totals that no single task has to make alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import kept

#: Rows that one range of the order should hold, and the most quantiles that are asked for.
RANGE_ROWS, MOST_BOUNDS = 500_000, 128
#: Totals of groups and ranges that are sent to all tasks, so that rows needn't move to meet them.
FEW = 50_000


def _case(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are less than the value, as nested comparisons."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.lit(bounds[mid]) < value, pick(mid + 1, high)).otherwise(pick(low, mid))

    return pick(0, len(bounds))


def _ranges(rows: DataFrame, order: str) -> Column:
    """The range of a row, rising with ``order``; equal values share one. The order is cut at
    quantiles of all rows, and between two of them in equal widths as the rows grow."""
    n = -(-rows.count() // RANGE_ROWS)
    if n <= 1:
        return F.lit(0).cast("long")
    k = min(n, MOST_BOUNDS)
    bounds = sorted({float(b) for b in rows.approxQuantile(order, [i / k for i in range(k + 1)], 0.25 / k)})
    if len(bounds) < 2:
        return F.lit(0).cast("long")
    at = _case(F.col(order), bounds[1:-1])
    more = -(-n // k)
    if more == 1:
        return at.cast("long")
    low = F.get(F.array(*[F.lit(b) for b in bounds[:-1]]), at)
    high = F.get(F.array(*[F.lit(b) for b in bounds[1:]]), at)
    inner = F.floor((F.col(order) - low) / (high - low) * more)
    return (at * more + F.least(F.greatest(inner, F.lit(0)), F.lit(more - 1))).cast("long")


def running_totals(
    rows: DataFrame,
    groups: list[str],
    order: str,
    ties: list[str | Column],
    totals: dict[str, Column],
    descending: bool = False,
    uniform: bool = False,
    wanted: Column | None = None,
) -> DataFrame:
    """``rows`` with the inclusive running totals of each group, by ``order`` and then ``ties``.

    The order is cut into ranges of rows (of equal width, if values are ``uniform`` from 0 to 1).
    Totals of the ranges are added up per group, rows count on within their range only, so a
    group with most of the rows is spread over all ranges. Ranges for which ``wanted`` (over
    columns of the group and ``__before_<name>``, the totals before the range) is false are left
    out before any row is sorted.
    """
    if uniform:
        n = max(1, -(-rows.count() // RANGE_ROWS))
        at = F.least(F.floor(F.col(order) * n), F.lit(n - 1)).cast("long")
    else:
        at = _ranges(rows, order)
    held = rows.select("*", *[c.alias(f"__{name}") for name, c in totals.items()], (-at if descending else at).alias("__range"))
    sums = held.groupBy(*groups, "__range").agg(*[F.sum(f"__{name}").alias(f"__sum_{name}") for name in totals])
    earlier = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"__of_{g}") for g in groups], F.col("__range").alias("__at"), *[F.coalesce(F.sum(f"__sum_{name}").over(earlier), F.lit(0)).alias(f"__before_{name}") for name in totals])
    sums = kept(sums)
    sums = F.broadcast(sums) if sums.count() <= FEW else sums
    same = [F.col(g).eqNullSafe(F.col(f"__of_{g}")) for g in groups]
    held = held.join(sums, [*same, F.col("__range") == F.col("__at")])
    if wanted is not None:
        held = held.where(wanted)
    by = F.col(order).desc() if descending else F.col(order).asc()
    within = Window.partitionBy(*groups, "__range").orderBy(by, *ties).rowsBetween(Window.unboundedPreceding, 0)
    count = [(F.sum(f"__{name}").over(within) + F.col(f"__before_{name}")).alias(name) for name in totals]
    return held.select(*rows.columns, *count)
