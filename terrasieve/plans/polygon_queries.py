"""Many polygons over the test tables: forty groups of points, each within a star around its
middle whose corners are the farthest points of twelve sectors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as N
from ..operators import lookup as L
from ..operators import polygons as P
from ..registry import query
from .metric_queries import r9
from .raster_queries import BANDS, CELLS, VALID, drawn, held
from .spatial_queries import POINTS, points

GROUPS, SECTORS = 40, 12
STARS = f"""k AS (SELECT id % {GROUPS} AS polygon, id, x, y FROM p),
m AS (SELECT polygon, avg(x) AS cx, avg(y) AS cy FROM k GROUP BY polygon),
s AS (
  SELECT polygon, least(floor((atan2(y - cy, x - cx) + {math.pi!r}::DOUBLE) / {2 * math.pi / SECTORS!r}::DOUBLE), {SECTORS - 1})::BIGINT AS sector, id, x, y,
    (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2
  FROM k JOIN m USING (polygon)
), v AS (SELECT polygon, sector, arg_max(x, {{d2: d2, id: -id}}) AS x, arg_max(y, {{d2: d2, id: -id}}) AS y FROM s GROUP BY polygon, sector),
e AS MATERIALIZED (
  SELECT polygon, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM v WINDOW w AS (PARTITION BY polygon ORDER BY sector)
)"""
#: Pairs of a place (of ``q``: id, x, y) and a polygon that holds it.
HELD = """
  SELECT id, polygon FROM q JOIN e ON (y1 > q.y) <> (y2 > q.y) AND q.x < (x2 - x1) * (q.y - y1) / (y2 - y1) + x1
  GROUP BY id, polygon HAVING count(*) % 2 = 1"""
#: The distance of a place of ``q`` to an edge of ``e``.
ALONG = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((q.x - x1) * (x2 - x1) + (q.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
APART = f"sqrt((q.x - x1 - {ALONG} * (x2 - x1)) * (q.x - x1 - {ALONG} * (x2 - x1)) + (q.y - y1 - {ALONG} * (y2 - y1)) * (q.y - y1 - {ALONG} * (y2 - y1)))"
IN_STARS = f"{POINTS}, q AS (SELECT id, x, y FROM p), {STARS}, held AS ({HELD})"


def stars(spark: SparkSession, sf: str) -> DataFrame:
    own = points(spark, sf).withColumn("polygon", F.col("id") % GROUPS)
    middle = own.groupBy("polygon").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    sector = F.least(F.floor((F.atan2(dy, dx) + math.pi) / (2 * math.pi / SECTORS)), F.lit(SECTORS - 1))
    far = F.max(F.struct((dx * dx + dy * dy).alias("d2"), (-F.col("id")).alias("low"), "x", "y")).alias("far")
    corners = own.join(middle, "polygon").groupBy("polygon", sector.alias("sector")).agg(far)
    listed = corners.groupBy("polygon").agg(F.array_sort(F.collect_list(F.struct("sector", "far.x", "far.y"))).alias("c"))  # one of each sector
    return listed.select("polygon", F.transform("c", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("corners"))


@query(f"WITH {IN_STARS} SELECT id, polygon FROM held")
def points_in_polygons(spark: SparkSession, sf: str) -> DataFrame:
    return P.points_in(points(spark, sf), stars(spark, sf), 0.02)


@query(f"""WITH {IN_STARS}, d AS (SELECT id, polygon, min({APART}) AS d FROM q, e WHERE x1 <> x2 OR y1 <> y2 GROUP BY ALL)
SELECT id, polygon, CASE WHEN (id, polygon) IN (SELECT (id, polygon) FROM held) THEN 0 ELSE round(d, 9) END AS d FROM d
WHERE d <= 2e-2 OR (id, polygon) IN (SELECT (id, polygon) FROM held)""")
def points_near_polygons(spark: SparkSession, sf: str) -> DataFrame:
    return r9(P.points_near(points(spark, sf), stars(spark, sf), 0.02), "d")


SOME = "e AS (SELECT * FROM every WHERE polygon < 3)"


@query(f"WITH {POINTS}, q AS (SELECT id, x, y FROM p), {STARS.replace('e AS MATERIALIZED', 'every AS MATERIALIZED')}, {SOME}, held AS ({HELD}) SELECT id FROM q WHERE id NOT IN (SELECT id FROM held)")
def points_outside_union(spark: SparkSession, sf: str) -> DataFrame:
    return P.outside(points(spark, sf), stars(spark, sf).where("polygon < 3"), 0.02).select("id")


@query(f"WITH {POINTS}, q AS (SELECT id, x, y FROM p), {STARS} SELECT polygon, min(x1) AS \"left\", min(y1) AS bottom, max(x1) AS \"right\", max(y1) AS top FROM e WHERE x1 <> x2 OR y1 <> y2 GROUP BY polygon")
def polygon_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return P.bounds(stars(spark, sf))


QUOTA, MOST = 400, 20_000


@query(f"""WITH {CELLS}, {STARS.replace('e AS MATERIALIZED', 'every AS MATERIALIZED')}, {SOME}, q AS MATERIALIZED (
  SELECT i AS id, -15e-2 + 0.96::DOUBLE * ({drawn("'11'", "i", "'x'")}) AS x, -40e-2 + 0.6::DOUBLE * ({drawn("'11'", "i", "'y'")}) AS y FROM (SELECT unnest(range({MOST})) AS i)
), held AS ({HELD}), real AS (
  SELECT id, x, y, round(f0, 9) AS f0 FROM (SELECT id, x, y, floor((20e-2 - y) / 1e-2)::BIGINT AS row, floor((x - (-15e-2)) / 1e-2)::BIGINT AS col FROM q) JOIN w USING (row, col) WHERE {VALID}
), ok AS (
  SELECT id, x, y, f0, row_number() OVER (ORDER BY id) AS rn FROM real WHERE id NOT IN (SELECT id FROM held)
) SELECT id, round(x, 9) AS x, round(y, 9) AS y, f0, rn, format('U_{{:06d}}', rn) AS candidate_id FROM ok WHERE rn <= {QUOTA}""")
def quota_of_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Places with real values in every band that no polygon holds, in batches until the quota."""
    _, raster, g = held(spark, sf)
    some = stars(spark, sf).where("polygon < 3")

    def accept(draws: DataFrame) -> DataFrame:
        real = L.with_valid_factors(draws, raster, g, BANDS).select("id", "x", "y", "f0")
        return P.outside(real, some, 0.05)

    return r9(N.accepted_points(spark, (-0.15, -0.4, 0.81, 0.2), accept, QUOTA, 250, MOST, 11), "x", "y", "f0")
