"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, temporary


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Links the neighbours of each node (the larger ones, or the node and its smaller ones)
    to the least node of its neighbourhood. The least is found by an aggregate that combines
    before the shuffle, so that a node with very many links is no one task's work."""
    if larger:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``edges (a, b)``.

    Each round ends in a written table, and stops when a round changes nothing; the tables go. Null ends and
    loops are ignored; an empty table gives an empty result.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct()
    mark = None
    with temporary(edges.sparkSession):
        now = materialise(pairs, "edges")
        for _ in range(max_rounds):
            now = materialise(_star(_star(now, True), False), "edges")
            seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
            if (seen.n, seen.h) == mark:
                break
            mark = (seen.n, seen.h)
        else:
            raise RuntimeError("components did not settle")
        found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
        return materialise(found, "components", keep=True)
