"""Point inventories from tables, GeoJSON and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names that hold coordinates, in the order in which they are looked for (any case).
COORDINATES = (("x", "y"), ("lon", "lat"), ("longitude", "latitude"), ("point_x", "point_y"))
FEATURES = "features array<struct<geometry: struct<type: string, coordinates: array<double>>, properties: map<string, string>>>"


def coordinate_columns(columns: list[str]) -> tuple[str, str]:
    known = {c.lower(): c for c in columns}
    for x, y in COORDINATES:
        if x in known and y in known:
            return known[x], known[y]
    raise ValueError(f"no coordinates among {columns}")


def numeric_points(rows: DataFrame) -> DataFrame:
    """``rows`` with ``x`` and ``y`` as numbers; rows where either is no number go."""
    x, y = coordinate_columns(rows.columns)
    rest = [c for c in rows.columns if c not in (x, y)]
    out = rows.select(*rest, F.col(x).cast("string").try_cast("double").alias("x"), F.col(y).cast("string").try_cast("double").alias("y"))
    return out.where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def read_geojson(spark: SparkSession, path: str, only_points: bool = True) -> DataFrame:
    """``point_id, lon, lat, properties`` of the features of FeatureCollections: of points, or of
    all that have coordinates of one place."""
    each = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.posexplode("features").alias("pos", "f"))
    each = each.where("f.geometry.type = 'Point'" if only_points else "f.geometry.coordinates is not null")
    place = lambda i: F.get("f.geometry.coordinates", F.lit(i))
    return each.select(F.format_string("P_%05d", "pos").alias("point_id"), place(0).alias("lon"), place(1).alias("lat"), F.col("f.properties").alias("properties"))


def read_result_files(spark: SparkSession, path: str, schema: str, without: str | None = None) -> DataFrame:
    """CSV files below a path with ``file`` (order by it is order by name) and ``tag`` (the folder
    two levels up), those whose path holds ``without`` left out."""
    reader = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", "*.csv").csv(path).withColumn("file", F.input_file_name())
    if without:
        rows = rows.where(~F.col("file").contains(without))
    return rows.withColumn("tag", F.element_at(F.split("file", "/"), -3))


def file_ranks(rows: DataFrame) -> DataFrame:
    """``file, file_rank``: the place of each file of ``read_result_files`` by name, from 1."""
    return rows.select("file").distinct().select("file", F.row_number().over(Window.orderBy("file")).alias("file_rank"))


def read_by_size(spark: SparkSession, paths: dict[int, str], schema: str | None = None) -> DataFrame:
    """CSV indexes with a header, one for each size of patch, as one table with ``patch_size``."""
    out = None
    for size, path in sorted(paths.items()):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        own = reader.csv(path).withColumn("patch_size", F.lit(size))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no index is given")
    return out


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a stated order."""
    return rows.orderBy(*order).limit(n)


#: Names under which inventories of points are delivered, fixed values.
POINT_FILE, POINT_PREFIX = "landslide_points.csv", "landslide"


def point_file(names: list[str], preferred: str = POINT_FILE, prefix: str = POINT_PREFIX) -> str:
    """The file of points among names of a folder: the preferred one, else the only CSV file with
    the prefix; none or several are an error."""
    if preferred in names:
        return preferred
    found = sorted(n for n in names if n.lower().startswith(prefix) and n.lower().endswith(".csv"))
    if len(found) != 1:
        raise ValueError(f"one file of points is needed, there are {found}")
    return found[0]


def optional_points(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A table of points, or an empty one if there is none."""
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def samples(rows: DataFrame, label: int, source: str, prefix: str, factors: list[str], key: str = "sample_id") -> DataFrame:
    """Samples ready to join others: numeric places, factors that are all real, a label and a
    source, and an id where it is missing (by place, x before y)."""
    from ..functions.scalars import is_valid
    from ..operators.quality import require_columns
    from ..operators.running import running_totals

    held = numeric_points(require_columns(rows, factors))
    for f in factors:
        held = held.where(is_valid(F.col(f).cast("double")))
    if key not in held.columns:
        held = held.withColumn(key, F.lit(None).cast("string"))
    held = running_totals(held, [], "x", ["y"], {"__n": F.lit(1)})
    named = F.when(F.coalesce(F.length(F.col(key)), F.lit(0)) == 0, F.format_string(f"{prefix}_%06d", "__n")).otherwise(F.col(key))
    return held.select(named.alias(key), "x", "y", *[F.col(f).cast("double").alias(f) for f in factors], F.lit(label).alias("label"), F.lit(source).alias("source"))
