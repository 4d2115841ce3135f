"""Reliable negatives by positive-unlabeled bagging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import coded, cut_points, score, train
from .sampling import bags
from .scratch import kept


def tally_votes(scored: DataFrame, key: str, p: str, below: float) -> DataFrame:
    """``key, times, votes, ratio, mean_p, sd_p`` from out-of-bag scores: a vote is a score
    below the limit."""
    out = scored.groupBy(key).agg(F.count(p).alias("times"), F.count_if(F.col(p) < below).alias("votes"), F.sum(p).alias("s1"), F.sum(F.col(p) * F.col(p)).alias("s2"))
    mean = F.try_divide("s1", "times")
    sd = F.sqrt(F.greatest(F.try_divide("s2", "times") - mean * mean, F.lit(0.0)))
    return out.select(key, "times", "votes", F.try_divide("votes", "times").alias("ratio"), mean.alias("mean_p"), sd.alias("sd_p"))


def reliable_negatives(votes: DataFrame, least_ratio: float) -> DataFrame:
    """Candidates scored at least once whose ratio is above the limit (not equal to it)."""
    return votes.where((F.col("times") > 0) & (F.col("ratio") > least_ratio))


def low_scored(rows: DataFrame, most: float, mean: str = "mean_p") -> DataFrame:
    """Candidates whose mean out-of-bag score is at most the limit (equal to it included)."""
    return rows.where(F.col(mean) <= most)


def standardised(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` on the scale of ``train``: population deviation, 1 where it is 0."""
    stats = train.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    held = rows.crossJoin(F.broadcast(stats))  # one row
    scale = lambda c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
    return held.select(*[scale(c).alias(c) if c in columns else rows[c] for c in rows.columns])


def bagged_scores(
    positives: DataFrame,
    unlabeled: DataFrame,
    columns: list[str],
    key: str,
    iterations: int,
    m: int,
    trees: int = 100,
    seed: int = 42,
    depth: int = 30,
) -> DataFrame:
    """``key, iteration, p``: in each iteration a random forest learns positives against m drawn
    unlabeled rows and scores those that were not drawn. All forests grow at the same time. Values
    are not standardised: the splits of trees go by the order of values, which an affine scale
    keeps."""
    every = positives.select(key, *columns).withColumn("y", F.lit(1)).unionByName(unlabeled.select(key, *columns).withColumn("y", F.lit(0)))
    cuts = cut_points(every, columns)
    tasks = 4 * every.sparkSession.sparkContext.defaultParallelism
    code = lambda rows: kept(coded(rows, columns, cuts, key).repartition(tasks, "row"))
    known, free = code(positives), code(unlabeled)
    # Who is drawn is told from digests, whenever it is asked for; copies of rows are not written.
    drawn, n = bags(free, iterations, m, seed, key), free.count()
    ones = known.select(F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"), "row", "codes", F.lit(1).alias("y"))
    rows = ones.unionByName(drawn.where("in_bag").select("iteration", "row", "codes", F.lit(0).alias("y")))
    forests = train(rows, trees, depth, seed, known.count() + m, iterations, len(columns))
    rest = drawn.where("not in_bag").select(key, "iteration", "codes")
    return score(rest, forests, key, max(0, n - m))
