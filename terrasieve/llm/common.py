"""Helpers that the text operators share: input shape, the shared folder, written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may do without it (tests); its one process shares every folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="terrasieve-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/terrasieve/{tag}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote below the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Paths written within ``temporary``, the innermost last.
_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes within go at the end, but those to ``keep``."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove_path(spark, path)


def materialise(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: the lineage ends
    there, so a lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    if _open and not keep:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), and columns named besides; all others go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def row_rank(docs: DataFrame) -> Column:
    """A hash over all columns of a row, by which rows that tie in their keys are told apart
    (columns of types without a hash, such as maps, are taken as JSON)."""
    plain = lambda f: F.to_json(F.struct(docs[f.name])) if "map" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else docs[f.name]
    return F.xxhash64(*[plain(f) for f in docs.schema.fields])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text, split at ASCII white space, as an array."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas use it often."""
    return F.transform(F.array(value), body)[0]


def _below(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at most the value, as nested comparisons."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= F.lit(bounds[mid]), pick(mid + 1, high)).otherwise(pick(low, mid))

    return pick(0, len(bounds))


def id_ranges(docs: DataFrame, per_range: int = 512, segments: int = 128) -> tuple[Column, DataFrame, int]:
    """Cuts the ids into ranges with about ``per_range`` rows each: the range of a ``doc_id``
    (from 0), ``range, following`` of the ranges that hold any (after the last: the first), and
    the least id. Ids are cut at ``segments`` quantiles, and each segment in equal widths, so that
    ids far from all others only widen the ranges of their own segment. The range that follows is
    looked for in groups of ranges, and the one that follows the last range of a group among
    groups."""
    seen = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("doc_id").alias("n")).first()
    least, value = seen.a or 0, F.col("doc_id").cast("double")
    k = max(1, min(segments, seen.n // per_range))
    cuts = docs.select(value.alias("v")).where("v is not null").approxQuantile("v", [i / k for i in range(1, k)], 0.25 / k) if k > 1 else []
    bounds = sorted({float(least), *cuts, float(seen.b or 0) + 1.0})
    bounds = bounds if len(bounds) > 1 else [bounds[0], bounds[0] + 1.0]
    width, at = max(1, -(-seen.n // (per_range * (len(bounds) - 1)))), _below(value, bounds[1:-1])
    low, high = (F.get(F.array(*[F.lit(b) for b in x]), at) for x in (bounds[:-1], bounds[1:]))
    inner = F.least(F.floor((value - low) / (high - low) * width), F.lit(width - 1))
    number = (at * width + inner).cast("long")
    held = docs.where("doc_id is not null").select(number.alias("range")).distinct().withColumn("group", F.floor(F.col("range") / 1024))
    held = held.withColumn("after", F.lead("range").over(Window.partitionBy("group").orderBy("range")))
    groups = held.groupBy("group").agg(F.min("range").alias("first"))
    groups = groups.select("group", F.lead("first").over(Window.orderBy("group")).alias("later"))
    return number, held.join(groups, "group").select("range", F.coalesce("after", "later", F.lit(0)).cast("long").alias("following")), least
