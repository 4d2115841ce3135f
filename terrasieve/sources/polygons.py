"""Polygons from GeoJSON files, as tables of rings.

A ring is a row ``polygon, part, ring, corners`` (an array of ``x, y``; the last corner needn't be
the first one again). Parts of a MultiPolygon and holes are rings of their own: what lies in an odd
number of a polygon's rings lies in the polygon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name under which mapped areas are delivered, and the forms that can be read here; fixed values.
POLYGON_FILE, FORMS = "landslide_polygons", (".geojson",)
SCHEMA = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
RINGS = "polygon string, part int, ring int, corners array<struct<x: double, y: double>>, properties map<string, string>"


def polygon_file(names: list[str], stem: str = POLYGON_FILE) -> str | None:
    """The first file by name (any case) that holds mapped areas, or none."""
    found = sorted((n for n in names if n.startswith(f"{stem}.") and n.lower().endswith(FORMS)), key=str.lower)
    return found[0] if found else None


def read_polygons(spark: SparkSession, path: str, prefix: str = "A") -> DataFrame:
    """The rings of all Polygon and MultiPolygon features of FeatureCollections, with the
    properties of their feature. Other features, empty geometries and corners without numbers
    go; so do rings of fewer than three corners."""
    each = spark.read.schema(SCHEMA).json(path, multiLine=True).withColumn("file", F.input_file_name())
    each = each.select("file", F.posexplode("features").alias("pos", "f")).select("file", "pos", "f.geometry.type", "f.geometry.coordinates", "f.properties")
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    parts = F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>"))
    rings = each.select("file", "pos", "properties", F.posexplode(parts).alias("part", "rings")).select("*", F.posexplode("rings").alias("ring", "points"))
    places = F.filter(F.transform("points", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    named = F.concat_ws("_", F.lit(prefix), F.element_at(F.split("file", "/"), -1), F.format_string("%05d", "pos"))
    return rings.select(named.alias("polygon"), "part", "ring", places.alias("corners"), "properties").where(F.size(F.array_distinct("corners")) >= 3)


def optional_polygons(spark: SparkSession, path: str | None) -> DataFrame:
    """The rings of a file, or an empty table if there is none."""
    return read_polygons(spark, path) if path else spark.createDataFrame([], RINGS)
