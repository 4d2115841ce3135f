"""Result tables that grow by jobs, and files beside them.

A result table is Parquet, partitioned by keys of a job. Writing a job again replaces what it
wrote before, so a job that was lost half-way is simply run again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import require_columns, violations
from ..operators.report import keep_last


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a table? Asked of Spark's reader, so any store will do."""
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def append_new(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> int:
    """Appends the rows whose keys the table does not have (null keys match): of rows that share
    keys the last by ``order``. How many there were; a second run adds none."""
    own = keep_last(rows, keys, order)
    if exists(rows.sparkSession, path):
        have = rows.sparkSession.read.parquet(path).select(*[F.col(k).alias(f"__{k}") for k in keys])
        own = own.join(have, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
    own = own.persist()
    n = own.count()
    if n:
        own.write.mode("append").parquet(path)
    own.unpersist()
    return n


def replace_jobs(rows: DataFrame, path: str, job: list[str]) -> None:
    """Writes the rows of whole jobs: partitions of other jobs stay, those of these jobs are
    replaced. After each job of a long run the table is complete up to there."""
    rows.repartition(*job).write.mode("overwrite").partitionBy(*job).option("partitionOverwriteMode", "dynamic").parquet(path)


def rewrite_deduplicated(spark: SparkSession, path: str, to: str, keys: list[str], order: list[str]) -> None:
    """A copy of a result table with the last row of each key. Never in place: the table is
    still being read while the copy is written."""
    keep_last(spark.read.parquet(path), keys, order).write.mode("overwrite").parquet(to)


def write_checked(rows: DataFrame, path: str, rules: dict, columns: list[str], form: str = "parquet") -> None:
    """Writes rows that have the columns, in this order, and break no rule; else an error, and
    nothing is written."""
    rows = require_columns(rows.select(*columns), columns, exact=True)
    broken = {r.rule: r.n for r in violations(rows, rules).where("n > 0").collect()}
    if broken:
        raise ValueError(f"quality rules are broken: {broken}")
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def write_index(index: DataFrame, path: str, part: str = "patch_size") -> None:
    """A patch index, a partition for each size of patch."""
    index.write.mode("overwrite").partitionBy(part).parquet(path)


def write_common(index: DataFrame, path: str, key: str, sizes: list[int], part: str = "patch_size") -> int:
    """The index of the ids that are valid (``valid_patch``) at all sizes, and the table of these
    ids beside it (``<path>/ids``, ``<path>/index``); how many ids there are. An id that is twice
    at one size is an error, and nothing is written."""
    valid = index.where(F.col("valid_patch") & F.col(part).isin(sizes))
    if not (twice := valid.groupBy(key, part).agg(F.count("*").alias("n")).where("n > 1").limit(3)).isEmpty():
        raise ValueError(f"ids are repeated: {twice.collect()}")
    ids = valid.groupBy(key).agg(F.count_distinct(part).alias("n")).where(F.col("n") == len(set(sizes))).select(key)
    ids.write.mode("overwrite").parquet(f"{path}/ids")
    known = index.sparkSession.read.parquet(f"{path}/ids")
    write_index(valid.join(known, key, "left_semi"), f"{path}/index", part)
    return known.count()


def half(value: Column) -> Column:
    """A number as a 16-bit float would hold it: 11 bits of precision, rounded half to even, steps
    of 2^-24 near zero, infinite from 65520 on. NaN and null stay."""
    size = F.abs(value)
    power = F.greatest(F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size))), F.lit(-14))
    step = F.pow(F.lit(2.0), power - 10)
    rounded = F.rint(value / step) * step
    return F.when(F.isnan(value) | (size == 0) | (size == float("inf")), value).when(size >= 65520, F.signum(value) * float("inf")).otherwise(rounded)


def write_arrays(patches: DataFrame, path: str, size: int, bands: int, halves: bool = False) -> None:
    """Patches in long form as one array of floats each, in the order of band, row and column;
    with ``halves`` rounded to what 16-bit floats hold (Parquet has no such type in Spark, but
    rounded floats compress to little more)."""
    if halves:
        patches = patches.withColumn("v", half(F.col("v").cast("double")))
    place = (F.col("band") * size + F.col("row")) * size + F.col("col")
    packed = patches.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(place.alias("i"), F.col("v").cast("float").alias("v")))).alias("p"))
    out = packed.select("id", F.transform("p", lambda x: x["v"]).alias("values"), F.lit(bands).alias("bands"), F.lit(size).alias("size"))
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_arrays`` wrote, in long form."""
    each = spark.read.parquet(path).select("id", "size", F.posexplode("values").alias("i", "v"))
    i, n = F.col("i"), F.col("size")
    return each.select("id", F.floor(i / (n * n)).alias("band"), (F.floor(i / n) % n).alias("row"), (i % n).alias("col"), F.col("v").cast("double").alias("v"))


def manifest(spark: SparkSession, tables: dict[str, str], settings: dict) -> DataFrame:
    """One row ``manifest``: settings and the number of rows and columns of each table, as JSON
    with sorted keys."""
    seen = {}
    for name, path in sorted(tables.items()):
        df = spark.read.parquet(path)
        seen[name] = {"columns": df.columns, "path": path, "rows": df.count()}
    text = json.dumps({"settings": settings, "tables": seen}, sort_keys=True)
    return spark.createDataFrame([(text,)], "manifest string")


def write_text(lines: DataFrame, path: str) -> None:
    """A small report, one file of lines."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def markdown(summary: DataFrame, columns: dict[str, str], order: str) -> DataFrame:
    """``line``: a summary as a Markdown table in the order of a column; ``columns`` gives the
    format of each (``%s``, ``%.3f``); nulls are a dash. For summaries: lines are sorted in one
    task."""
    spark = summary.sparkSession
    head = [(-2, "| " + " | ".join(columns) + " |"), (-1, "|" + "---|" * len(columns))]
    cells = [F.coalesce(F.format_string(f, F.when(F.col(c).isNotNull(), F.col(c))), F.lit("-")) for c, f in columns.items()]
    cells = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(x) for c, x in zip(columns, cells, strict=True)]
    rows = summary.select(F.col(order).alias("o"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    ranked = rows.select((F.row_number().over(_by("o"))).alias("n"), "line")
    return spark.createDataFrame(head, "n int, line string").unionByName(ranked).coalesce(1).sortWithinPartitions("n").select("line")


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def features(points: DataFrame, properties: list[str]) -> DataFrame:
    """``feature``: points (``lon, lat``) as GeoJSON features, one JSON text each (a file of them
    is newline-delimited GeoJSON)."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def feature_collection(points: DataFrame, properties: list[str]) -> DataFrame:
    """``collection``: one FeatureCollection. A file of this form is one JSON value, so it is for
    inventories; larger sets go as lines of ``features``."""
    each = features(points, properties).agg(F.concat_ws(",", F.array_sort(F.collect_list("feature"))).alias("f"))
    return each.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("collection"))


def write_experiment(path: str, job: list[str], **tables: DataFrame) -> None:
    """The tables of an experiment (predictions, fold metrics, summary, log), each below its name
    and replaced job by job."""
    for name, rows in tables.items():
        replace_jobs(rows, f"{path}/{name}", job)
