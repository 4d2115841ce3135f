"""Banks of permutations: tables ``perm_id, perm`` of a few hundred rows for puzzle tasks."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from .scratch import kept


def all_permutations(spark: SparkSession, n: int) -> DataFrame:
    """Every permutation of n parts, the identity first."""
    return spark.createDataFrame(list(enumerate(map(list, itertools.permutations(range(n))))), "perm_id int, perm array<int>")


def drawn_for(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """``id, perm``: distinct permutations drawn by digest for ids, with the least id of each:
    places sorted by a number drawn for each."""
    place = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(uniform(seed, F.col("id"), i).alias("u"), i.alias("i")))
    every = ids.select("id", F.transform(F.array_sort(place), lambda x: x["i"]).alias("perm"))
    return every.groupBy("perm").agg(F.min("id").alias("id")).select("id", "perm")


def candidates(spark: SparkSession, n: int, count: int, seed: int) -> DataFrame:
    """``id, perm``: distinct permutations of so many draws."""
    return drawn_for(spark.range(count), n, seed)


def hamming(a: Column, b: Column) -> Column:
    """At how many places two arrays differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def diverse(pool: DataFrame, size: int) -> DataFrame:
    """``perm_id, perm, distance``: the least candidate, then again and again the one farthest
    from all chosen (the lower id on ties); ``distance`` is how far it was. The size is a
    parameter of a task (a hundred or so): one aggregate over the pool for each."""
    pool = kept(pool)
    if pool.count() < size:
        raise ValueError("the pool has fewer permutations than the bank needs")
    first = pool.orderBy("id").limit(1).first()
    chosen, held = [(0, list(first.perm), None)], pool.where(F.col("id") != first.id).withColumn("d", F.lit(math.inf))
    last = first.perm
    for k in range(1, size):
        held = held.withColumn("d", F.least("d", hamming(F.col("perm"), F.array(*[F.lit(x) for x in last])).cast("double")))
        if k % 16 == 0:
            held = kept(held)
        best = held.agg(F.max(F.struct("d", (-F.col("id")).alias("low"), "perm")).alias("b")).first().b
        held = held.where(F.col("id") != -best.low)
        chosen.append((k, list(best.perm), int(best.d)))
        last = best.perm
    return pool.sparkSession.createDataFrame(chosen, "perm_id int, perm array<int>, distance int")


def broken(bank: DataFrame, n: int, count: int | None = None) -> DataFrame:
    """``rule, n``: rows that are no permutation of n parts, class ids out of order, repeated
    permutations, and a wrong number of rows."""
    whole = F.coalesce(F.array_sort("perm") == F.sequence(F.lit(0), F.lit(n - 1)), F.lit(False))
    one = bank.agg(
        F.count_if(~whole).alias("no permutation"),
        (F.count("*") - F.count_distinct("perm")).alias("repeated"),
        (F.count("*") - F.count_distinct(F.when(F.col("perm_id").between(0, F.lit(2**31 - 1)), F.col("perm_id")))).alias("class ids"),
        F.abs(F.count("*") - F.lit(count) if count is not None else F.lit(0)).alias("number of rows"),
        (F.coalesce(F.max("perm_id"), F.lit(-1)) + 1 - F.count("*")).alias("gaps in class ids"),
    )
    rules = [F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("long").alias("n")) for c in one.columns]
    return one.select(F.explode(F.array(*rules)).alias("r")).select("r.rule", "r.n")


def wide(bank: DataFrame, n: int) -> DataFrame:
    """``perm_id, position_00, ...``: the form in which banks are stored."""
    return bank.select("perm_id", *[F.get("perm", F.lit(i)).alias(f"position_{i:02d}") for i in range(n)])


def from_wide(rows: DataFrame) -> DataFrame:
    places = sorted(c for c in rows.columns if c.startswith("position_"))
    return rows.select(F.col("perm_id").cast("int").alias("perm_id"), F.array(*[F.col(c).cast("int") for c in places]).alias("perm"))


def shuffled_by_bank(rows: DataFrame, key: str, bank: DataFrame, seed: int) -> DataFrame:
    """``rows`` with a class of the bank drawn for each, and its permutation."""
    n = bank.count()
    out = rows.withColumn("perm_id", F.floor(uniform(seed, F.col(key), F.lit("bank")) * n).cast("int"))
    return out.join(F.broadcast(bank.select("perm_id", "perm")), "perm_id")  # a bank has a few hundred rows


def load_or_create_strips(spark: SparkSession, path: str, n: int = 3) -> DataFrame:
    """The bank of all orders of n strips, read from a file or written there. A file that holds
    anything else, or in another order, is an error."""
    from ..sinks.results import exists

    want = all_permutations(spark, n)
    if not exists(spark, path):
        wide(want, n).write.parquet(path)
    held = from_wide(spark.read.parquet(path))
    if sorted(map(tuple, held.collect())) != sorted(map(tuple, want.collect())):  # n! rows
        raise ValueError(f"{path} is not the bank of all orders of {n} strips")
    return held
