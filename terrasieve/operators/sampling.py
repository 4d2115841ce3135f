"""Exact samples, splits and folds. Order within a stratum comes from the MD5 of seed and id, so
a pick is the same in every run and engine. The first ranks of a stratum are found by range of
the digest (see ``ranked``), never by sorting a whole stratum in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_totals
from .scratch import kept


def draw_key(seed: int | str, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def share_key(digest: str) -> Column:
    """The first 32 bits of a hexadecimal digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ranked(rows: DataFrame, strata: list[str], seed: int | str, key: str, extra: tuple[str, ...] = (), wanted: Column | None = None) -> DataFrame:
    """``rows`` with ``rn``: the place of each row in its stratum in digest order, from 1.
    ``wanted`` (see ``running_totals``) leaves out ranges that hold no row of interest."""
    held = rows.withColumn("__digest", draw_key(seed, *extra, key)).withColumn("__head", share_key("__digest"))
    out = running_totals(held, strata, "__head", ["__digest", key], {"rn": F.lit(1)}, uniform=True, wanted=wanted)
    return out.drop("__digest", "__head")


def _with_sizes(rows: DataFrame, strata: list[str]) -> DataFrame:
    """``rows`` with ``__n``, the size of the stratum."""
    sizes = rows.groupBy(*[F.col(s).alias(f"__of_{s}") for s in strata]).agg(F.count("*").alias("__n"))
    if not strata:
        return rows.join(sizes, F.lit(True))  # one row
    same = [F.col(s).eqNullSafe(F.col(f"__of_{s}")) for s in strata]
    return rows.join(sizes, same).select(*rows.columns, "__n")


def sample_n(rows: DataFrame, strata: list[str], n: Column, seed: int | str, key: str) -> DataFrame:
    """``n`` rows of each stratum (or all): ``n`` may use ``__n``, the size of the stratum."""
    out = ranked(_with_sizes(rows, strata), strata, seed, key, wanted=F.col("__before_rn") < n)
    return out.where(F.col("rn") <= n).select(*rows.columns)


def proportional(rows: DataFrame, strata: list[str], fraction: float, seed: int, key: str, least: int = 2) -> DataFrame:
    """Of each stratum the rounded share (half to even), ``least`` rows at least."""
    return sample_n(rows, strata, F.greatest(F.lit(least), F.rint(F.col("__n") * fraction)), seed, key)


def balanced(rows: DataFrame, cluster: str, label: str, seed: int, key: str) -> DataFrame:
    """Per cluster as many rows of label 0 as of label 1: the lesser of both counts."""
    counts = rows.groupBy(cluster).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    out = ranked(rows, [cluster, label], seed, key).join(counts, cluster)
    return out.where(F.col("rn") <= F.least("n0", "n1")).select(*rows.columns)


def k_folds(rows: DataFrame, strata: list[str], k: int, seed: int, key: str) -> DataFrame:
    """``rows`` with ``fold``: strata are dealt to the folds in turn."""
    return ranked(rows, strata, seed, key).withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn")


def split(rows: DataFrame, strata: list[str], share: float, seed: int, key: str, rounded=F.rint) -> DataFrame:
    """``rows`` with ``part``: train, or validation for the rounded share of each stratum."""
    out = ranked(_with_sizes(rows, strata), strata, seed, key)
    part = F.when(F.col("rn") <= rounded(F.col("__n") * share), "validation").otherwise("train")
    return out.select(*rows.columns, part.alias("part"))


def _edges(each: DataFrame, n: int, m: int, key: str) -> DataFrame:
    """``__of, __edge``: the digest and key of the last of m rows of each iteration in digest
    order. Digests are even, so the m-th lies near m / n: rows below a window around it are
    counted, and only those within are ranked. A window without it is widened."""
    share, found, left = m / n, None, each
    slack = 8 * math.sqrt(share * (1 - share) / n) + 8 / n
    while True:
        low, high = max(0.0, share - slack), share + slack
        below = left.groupBy("iteration").agg(F.count_if(F.col("__head") < low).alias("__below"))
        near = left.where((F.col("__head") >= low) & (F.col("__head") <= high)).join(F.broadcast(below.withColumnRenamed("iteration", "__of")), F.col("iteration") == F.col("__of"))
        rank = F.row_number().over(Window.partitionBy("iteration").orderBy("__digest", key))
        hit = near.withColumn("__rank", rank + F.col("__below")).where(F.col("__rank") == m).select("__of", F.struct("__digest", F.col(key).alias("__key")).alias("__edge"))
        hit = kept(hit)  # a row for each iteration: the digests are not made again
        found = hit if found is None else found.unionByName(hit)
        left = left.join(F.broadcast(hit.select("__of")), F.col("iteration") == F.col("__of"), "left_anti")
        if high > 1 and low == 0 or left.isEmpty():
            return found
        slack *= 8


def bags(rows: DataFrame, iterations: int, m: int, seed: int, key: str) -> DataFrame:
    """``iteration`` and ``in_bag`` for every row: each iteration draws m rows, the rest is out.
    Keys are unique; the digest of an iteration's last row tells who is in, so rows are neither
    sorted nor numbered."""
    n = rows.count()
    each = rows.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    if m <= 0 or m >= n:
        return each.withColumn("in_bag", F.lit(m > 0))
    own = each.withColumn("__digest", draw_key(seed, "iteration", key)).withColumn("__head", share_key("__digest"))
    edges = _edges(own.select("iteration", key, "__digest", "__head"), n, m, key)  # a row for each iteration
    held = own.join(F.broadcast(edges), F.col("iteration") == F.col("__of"))
    inside = F.struct("__digest", F.col(key).alias("__key")) <= F.col("__edge")
    return held.select(*each.columns, inside.alias("in_bag"))


def capacities(n: int, k: int) -> list[int]:
    """Sizes of k parts of n that differ by one at most, larger ones first."""
    return [n // k + (i < n % k) for i in range(k)]


def capacities_by(rows: DataFrame, group: str, k: int) -> DataFrame:
    """``group, k, capacity``: sizes of k parts of the rows of each group, as ``capacities``."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n"))
    each = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.select(group, "k", (F.floor(F.col("__n") / k) + (F.col("k") < F.col("__n") % k).cast("int")).alias("capacity"))


def filled_counts(rows: DataFrame, column: str, k: int) -> DataFrame:
    """Counts of the values 0 to k - 1, zeros included."""
    counts = rows.groupBy(F.col(column).cast("long").alias(column)).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(k).select(F.col("id").alias(column)).join(counts, column, "left").na.fill({"n": 0})


def common_ids(rows: DataFrame, key: str, part: str, n_parts: int) -> DataFrame:
    """Ids that occur in every part."""
    return rows.groupBy(key).agg(F.count_distinct(part).alias("n")).where(F.col("n") == n_parts).select(key)


def group_folds(groups: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    """Folds of whole groups with even label counts: groups (``group, n_pos, n_neg``) are dealt
    to the folds by size, the largest first, there and back again (0, 1, ..., k - 1, k - 1, ...,
    0, 0, ...). Groups of the same counts stand in digest order."""
    held = groups.withColumn("__digest", draw_key(seed, group))
    # Rises as groups get smaller; the digest spreads groups of one size over ranges.
    size = F.col("n_pos") * F.lit(4194304.0) + F.col("n_neg") * F.lit(4.0)
    held = held.withColumn("__order", share_key("__digest") - size)
    ties = [F.desc("n_pos"), F.desc("n_neg"), F.col("__digest"), F.col(group)]
    out = running_totals(held, [], "__order", ties, {"__rn": F.lit(1)})
    turn, place = F.floor((F.col("__rn") - 1) / k), (F.col("__rn") - 1) % k
    return out.select(group, F.when(turn % 2 == 0, place).otherwise(k - 1 - place).cast("int").alias("fold"))
