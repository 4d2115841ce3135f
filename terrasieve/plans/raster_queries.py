"""One large grid over the test tables: the 64 numbers of an embedding are a tile of 8 by 8
pixels, four vectors are the bands of a tile, twelve tiles a row of tiles. Points are the first
two numbers of an embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import candidates as N
from ..operators import gaps as V
from ..operators import geo as G
from ..operators import lookup as L
from ..operators import patch as T
from ..operators import raster as R
from ..registry import query, table
from .metric_queries import r9
from .spatial_queries import CROSSINGS, POINTS, RING, points

BANDS = [0, 1, 2, 3]
NAMES = ["slope", "Aspect_deg", "LULC_2020", "soil_depth"]
LEFT, TOP, CELL, COLS = -0.15, 0.2, 0.01, 96

PIXELS = """r AS (
  SELECT vec_id % 4 AS band, vec_id // 4 // 12 * 8 + i // 8 AS row, vec_id // 4 % 12 * 8 + i % 8 AS col,
    CASE WHEN (vec_id * 64 + i) % 17 = 0 THEN -9999.0::DOUBLE ELSE embedding[i + 1]::DOUBLE END AS v
  FROM embeddings, (SELECT unnest(range(64)) AS i)
)"""
CELLS = f"""{POINTS}, {PIXELS}, size AS (SELECT max(row) + 1 AS n FROM r),
b AS (SELECT unnest(range(4)) AS band),
c AS (SELECT id, label, x, y, floor((20e-2 - y) / 1e-2)::BIGINT AS row, floor((x - (-15e-2)) / 1e-2)::BIGINT AS col FROM p),
w AS (
  SELECT row, col, max(v) FILTER (band = 0) AS f0, max(v) FILTER (band = 1) AS f1,
    max(v) FILTER (band = 2) AS f2, max(v) FILTER (band = 3) AS f3
  FROM r GROUP BY row, col
)"""
VALID = "f0 <> -9999 AND f1 <> -9999 AND f2 <> -9999 AND f3 <> -9999"
#: Patches of 4 by 4 around the cells of points.
CUT = f"""{CELLS}, cut AS (
  SELECT c.id, b.band, i AS row, j AS col, coalesce(r.v, -9999) AS v
  FROM c, b, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)
  LEFT JOIN r ON r.band = b.band AND r.row = c.row - 2 + i AND r.col = c.col - 2 + j
), mask AS (SELECT id, row, col, min(CASE WHEN v <> -9999 THEN 1 ELSE 0 END) AS m FROM cut GROUP BY ALL)"""
UNIFORM = "('0x' || substr(md5(concat_ws('|', {}))  , 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def drawn(*key: str) -> str:
    return UNIFORM.format(", ".join(f"({k})::VARCHAR" for k in key))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    each = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    tile = F.floor(F.col("vec_id") / 4)
    value = F.when((F.col("vec_id") * 64 + F.col("i")) % 17 == 0, S.NODATA).otherwise(F.col("e").cast("double"))
    return each.select(
        (F.col("vec_id") % 4).alias("band"),
        (F.floor(tile / 12) * 8 + F.floor(F.col("i") / 8)).alias("row"),
        (tile % 12 * 8 + F.col("i") % 8).cast("bigint").alias("col"),
        value.alias("v"),
    )


def grid(raster: DataFrame) -> L.Grid:
    return L.Grid(LEFT, TOP, CELL, CELL, (raster.agg(F.max("row")).first()[0] or 0) + 1, COLS)


def held(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, L.Grid]:
    raster = pixels(spark, sf)
    return points(spark, sf).drop("label"), raster, grid(raster)


@query(f"WITH {CELLS} SELECT id, row, col, f0, f1, f2, f3 FROM c LEFT JOIN w USING (row, col)")
def factor_values(spark: SparkSession, sf: str) -> DataFrame:
    p, r, g = held(spark, sf)
    return L.factor_values(p, r, g, BANDS).select("id", "row", "col", "f0", "f1", "f2", "f3")


@query(f"WITH {CELLS} SELECT id, row, col, f0, f1, f2, f3 FROM c JOIN w USING (row, col) WHERE {VALID}")
def valid_factor_points(spark: SparkSession, sf: str) -> DataFrame:
    p, r, g = held(spark, sf)
    return L.with_valid_factors(p, r, g, BANDS).select("id", "row", "col", "f0", "f1", "f2", "f3")


@query(f"WITH {CELLS} SELECT id FROM c, size WHERE x BETWEEN -15e-2 AND -15e-2 + 96 * 1e-2 AND y BETWEEN 20e-2 - n * 1e-2 AND 20e-2")
def points_in_bounds(spark: SparkSession, sf: str) -> DataFrame:
    p, _, g = held(spark, sf)
    return p.where(g.in_bounds(F.col("x"), F.col("y"))).select("id")


@query(f"WITH {CUT} SELECT id, band, row, col, v FROM cut")
def padded_windows(spark: SparkSession, sf: str) -> DataFrame:
    p, r, g = held(spark, sf)
    return L.patches(L.windows_of(p, g, 4), r, BANDS)


@query(f"""WITH {CELLS} SELECT id, row - 2 AS row_start, row + 2 AS row_stop, col - 2 AS col_start, col + 2 AS col_stop
FROM c, size WHERE row >= 2 AND row + 2 <= n AND col >= 2 AND col + 2 <= 96""")
def windows_inside(spark: SparkSession, sf: str) -> DataFrame:
    p, _, g = held(spark, sf)
    return L.windows_of(p, g, 4).where("inside").select("id", "row_start", "row_stop", "col_start", "col_stop")


INDEX = f"""{CUT}, ratio AS (SELECT id, 1 - avg(m) AS ratio FROM mask GROUP BY id),
index AS (
  SELECT id, c.row, c.col, c.row >= 2 AND c.row + 2 <= n AND c.col >= 2 AND c.col + 2 <= 96 AS inside, ratio
  FROM c JOIN ratio USING (id), size
)"""


@query(f"WITH {INDEX} SELECT id, row, col, inside, round(ratio, 9) AS nodata_ratio, inside AND ratio <= 0.25 AS valid_patch FROM index")
def patch_index(spark: SparkSession, sf: str) -> DataFrame:
    p, r, g = held(spark, sf)
    return r9(L.patch_index(p, r, g, 4, BANDS, 0.25), "nodata_ratio")


@query(f"""WITH {INDEX}, s AS (SELECT id FROM index WHERE inside AND ratio <= 0.25)
SELECT min(ratio)::DOUBLE AS least, max(ratio)::DOUBLE AS most, round(avg(ratio), 9) AS mean, round(stddev_pop(ratio), 9) AS sd,
  (SELECT count(*) FROM s) AS n_valid FROM index""")
def context_ratio_summary(spark: SparkSession, sf: str) -> DataFrame:
    p, r, g = held(spark, sf)
    rows = L.patch_index(p, r, g, 4, BANDS, 0.25)
    ratio = F.col("nodata_ratio")
    out = rows.agg(F.min(ratio).alias("least"), F.max(ratio).alias("most"), F.avg(ratio).alias("mean"), F.stddev_pop(ratio).alias("sd"), F.count_if("valid_patch").alias("n_valid"))
    return r9(out, "mean", "sd")


@query(f"""WITH {CUT}, centre AS (SELECT id FROM mask WHERE row = 2 AND col = 2 AND m = 1),
s AS (
  SELECT band, avg(v) AS mean, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-12)) AS sd
  FROM cut JOIN mask USING (id, row, col) JOIN centre USING (id) WHERE m = 1 GROUP BY band
)
SELECT id, band, row, col, round(CASE WHEN m = 1 THEN (v - mean) / (sd + 1e-6) ELSE 0 END, 6) AS v
FROM cut JOIN mask USING (id, row, col) JOIN centre USING (id) JOIN s USING (band)
UNION ALL SELECT id, 4, row, col, m::DOUBLE FROM mask JOIN centre USING (id)""")
def patch_items(spark: SparkSession, sf: str) -> DataFrame:
    p, r, g = held(spark, sf)
    return r9(L.patch_items(p, r, g, 4, BANDS), "v", digits=6)


@query(f"""WITH {CUT} SELECT id FROM mask WHERE row = 2 AND col = 2 AND m = 1""")
def real_centres(spark: SparkSession, sf: str) -> DataFrame:
    p, r, g = held(spark, sf)
    return T.centre_valid(T.context_mask(L.patches(L.windows_of(p, g, 4), r, BANDS)), 4)


@query(f"""WITH {CELLS}, v AS (
  SELECT c.id, i, j, r.v FROM c, b, (SELECT unnest(range(-3, 4)) AS i), (SELECT unnest(range(-3, 4)) AS j)
  JOIN r ON r.band = b.band AND r.row = c.row + i AND r.col = c.col + j AND r.v <> -9999
)
SELECT c.id, round(avg(v) FILTER (abs(i) <= 1 AND abs(j) <= 1), 9) AS small_mean, round(avg(v), 9) AS large_mean,
  count(v) FILTER (abs(i) <= 1 AND abs(j) <= 1) AS small_real, count(v) AS large_real,
  round(avg(v) FILTER (abs(i) <= 1 AND abs(j) <= 1) + 0.2 * avg(v), 9) AS fused
FROM c LEFT JOIN v USING (id) GROUP BY c.id""")
def dual_views(spark: SparkSession, sf: str) -> DataFrame:
    p, r, g = held(spark, sf)
    out = L.two_views(p, r, g, 3, 7, BANDS).withColumn("fused", F.col("small_mean") + 0.2 * F.col("large_mean"))
    return r9(out, "small_mean", "large_mean", "fused")


@query(f"""WITH {CUT}, a AS (SELECT id, band, row, col, v FROM cut), k AS (SELECT id, band, row, col, v::FLOAT::DOUBLE AS v FROM cut WHERE id % 5 <> 0 OR row > 0)
SELECT id, count(*) AS n, round(max(abs(a.v - k.v)), 9) AS most, count(*) FILTER (k.id IS NULL) AS missing
FROM a LEFT JOIN k USING (id, band, row, col) GROUP BY id""".replace("k.id IS NULL", "k.v IS NULL"))
def cache_check(spark: SparkSession, sf: str) -> DataFrame:
    p, r, g = held(spark, sf)
    fresh = L.patches(L.windows_of(p, g, 4), r, BANDS)
    cache = fresh.where("id % 5 <> 0 or row > 0").withColumn("v", F.col("v").cast("float").cast("double"))
    return r9(L.same_pixels(fresh, cache), "most")


@query(f"""WITH {CUT}, s AS (SELECT band, count(*) AS n, avg(v) AS mean, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-12)) AS sd
FROM cut JOIN mask USING (id, row, col) WHERE m = 1 AND id % 5 <> 0 GROUP BY band) SELECT band, n, round(mean, 8) AS mean, round(sd, 8) AS sd FROM s""")
def fold_channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    p, r, g = held(spark, sf)
    cut = L.patches(L.windows_of(p.where("id % 5 <> 0"), g, 4), r, BANDS)
    return r9(T.band_statistics(cut, T.context_mask(cut)), "mean", "sd", digits=8)


@query(f"""WITH {CUT} SELECT band, count(*) AS n, round(avg(v), 6) AS mean, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-12)), 6) AS sd FROM cut GROUP BY band""")
def unmasked_channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    p, r, g = held(spark, sf)
    cut = L.patches(L.windows_of(p, g, 4), r, BANDS)
    every = cut.select("id", "row", "col").distinct().withColumn("m", F.lit(1))
    return r9(T.band_statistics(cut, every), "mean", "sd", digits=6)


@query(f"WITH {PIXELS} SELECT band, count(*) AS valid_count, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS sd, min(v) AS least, max(v) AS most FROM r WHERE v <> -9999 GROUP BY band")
def band_summary(spark: SparkSession, sf: str) -> DataFrame:
    return r9(R.summary(pixels(spark, sf)), "mean", "sd")


@query(f"""WITH {PIXELS}, t AS (SELECT band, least(min(round_even(v * s, 0)), -9999) AS lo, greatest(max(round_even(v * s, 0)), -9999) AS hi
FROM (SELECT band, v, CASE band WHEN 0 THEN 10 WHEN 1 THEN 1e6 ELSE 1e12 END AS s FROM r WHERE v <> -9999) GROUP BY band)
SELECT band, CASE WHEN lo >= -32768 AND hi <= 32767 THEN 'int16' WHEN lo >= -2147483648 AND hi <= 2147483647 THEN 'int32' ELSE 'float64' END AS kind FROM t""")
def storage_types(spark: SparkSession, sf: str) -> DataFrame:
    r = pixels(spark, sf)
    scale = F.when(F.col("band") == 0, 10.0).when(F.col("band") == 1, 1e6).otherwise(1e12)
    return R.storage_type(r.withColumn("v", F.when(F.col("v") == S.NODATA, F.col("v")).otherwise(F.col("v") * scale)))


IN_AREA = CROSSINGS.replace("> y", "> y")
AREA = f"""area AS (
  SELECT row, col, ({IN_AREA}) % 2 = 1 AS in_area
  FROM (SELECT row, col, -15e-2 + (col + 5e-1) * 1e-2 AS x, 20e-2 - (row + 5e-1) * 1e-2 AS y FROM (SELECT DISTINCT row, col FROM r))
)"""


@query(f"WITH {PIXELS}, {AREA} SELECT row, col, in_area FROM area")
def study_area_mask(spark: SparkSession, sf: str) -> DataFrame:
    r = pixels(spark, sf)
    return R.study_mask(r.select("row", "col").distinct(), grid(r), RING)


#: For each gap of ``g`` the real pixels of ``k``, by quadrant: upper ones hold the gap's row, left
#: ones its column.
AROUND = """
  SELECT g.band, g.row, g.col, k.row AS r2, k.col AS c2, k.v, (g.row - k.row) * (g.row - k.row) + (g.col - k.col) * (g.col - k.col) AS d2,
    k.row <= g.row AS upper, k.col <= g.col AS lefter
  FROM g JOIN k ON k.band = g.band"""
QUARTERS = """
  SELECT band, row, col, sum(v / sqrt(d2)) / sum(1 / sqrt(d2)) AS smooth FROM (
    SELECT band, row, col, upper, lefter, min(d2) AS d2, arg_min(v, {d2: d2, away: abs(col - c2)}) AS v
    FROM around WHERE d2 <= 10000 GROUP BY ALL
  ) GROUP BY band, row, col"""
NEAREST = """
  SELECT band, row, col, arg_min(v, {d2: d2, row: r2, col: c2}) AS nearest FROM around GROUP BY band, row, col"""
FILLED = f"""{PIXELS}, {AREA}, h AS MATERIALIZED (
  SELECT band, row, col, CASE WHEN v = -9999 THEN v ELSE 100 * v END AS v, in_area FROM r JOIN area USING (row, col)
), g AS (SELECT * FROM h WHERE in_area AND v = -9999), k AS (SELECT * FROM h WHERE in_area AND v <> -9999),
around AS MATERIALIZED ({AROUND}), quarters AS ({QUARTERS}), near AS ({NEAREST}), done AS (
  SELECT h.band, h.row, h.col, h.v AS before,
    CASE WHEN NOT in_area THEN -9999 ELSE CASE h.band WHEN 1 THEN coalesce(nearest, h.v) WHEN 2 THEN round_even(coalesce(nearest, h.v), 0) + 0.0
      ELSE coalesce(smooth, h.v) END END AS v, in_area
  FROM h LEFT JOIN quarters USING (band, row, col) LEFT JOIN near USING (band, row, col)
)"""


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(NAMES)), "band int, name string")


def clean_bands(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = pixels(spark, sf)
    area = R.study_mask(r.select("row", "col").distinct(), grid(r), RING)
    r = r.withColumn("v", F.when(F.col("v") == S.NODATA, F.col("v")).otherwise(100 * F.col("v")))
    return r, area, R.cleaned(r, names(spark), area)


@query(f"WITH {FILLED} SELECT band, row, col, round(v, 9) AS v FROM done")
def cleaned_bands(spark: SparkSession, sf: str) -> DataFrame:
    return r9(clean_bands(spark, sf)[2], "v")


@query(f"""WITH {FILLED} SELECT band, count(*) AS n_inside, count(*) FILTER (before = -9999) AS n_missing, count(*) FILTER (before = -9999 AND v <> -9999) AS n_filled,
  round(100.0 * count(*) FILTER (before = -9999) / count(*), 9) AS percent, 100.0 * count(*) FILTER (before = -9999) / count(*) >= 25 AS warn FROM done WHERE in_area GROUP BY band""")
def cleaning_coverage(spark: SparkSession, sf: str) -> DataFrame:
    r, area, done = clean_bands(spark, sf)
    return r9(R.coverage(r, done, area), "percent")


@query(f"""WITH {FILLED} SELECT 'finite' AS rule, count(*) FILTER (isnan(v) OR isinf(v)) AS n FROM done UNION ALL
SELECT 'nodata outside', count(*) FILTER (NOT in_area AND v <> -9999) FROM done UNION ALL SELECT 'no gap inside', count(*) FILTER (in_area AND v = -9999) FROM done""")
def cleaned_band_rules(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.quality import violations

    _, area, done = clean_bands(spark, sf)
    gap = F.col("v") == S.NODATA
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    return violations(done.join(area, ["row", "col"]), {"finite": finite, "nodata outside": F.col("in_area") | gap, "no gap inside": ~F.col("in_area") | ~gap})


HOLES = f"""{PIXELS}, h AS MATERIALIZED (
  SELECT band, row, col, CASE WHEN row BETWEEN 10 + 8 * band AND 45 + 8 * band AND col BETWEEN 20 AND 36 + 8 * band THEN -9999 ELSE v END AS v FROM r
), g AS (SELECT * FROM h WHERE v = -9999), k AS (SELECT * FROM h WHERE v <> -9999), around AS ({AROUND})"""


def with_holes(spark: SparkSession, sf: str) -> DataFrame:
    """The grid without a large rectangle in each band."""
    band = F.col("band")
    hole = F.col("row").between(10 + 8 * band, 45 + 8 * band) & F.col("col").between(F.lit(20), 36 + 8 * band)
    return pixels(spark, sf).withColumn("v", F.when(hole, S.NODATA).otherwise(F.col("v")))


@query(f"WITH {HOLES}, near AS ({NEAREST}) SELECT band, row, col, coalesce(nearest, v) AS v FROM h LEFT JOIN near USING (band, row, col)")
def far_gaps_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return V.filled_nearest(with_holes(spark, sf), ["band"])


@query(f"WITH {HOLES}, quarters AS ({QUARTERS}) SELECT band, row, col, round(coalesce(smooth, v), 9) AS v FROM h LEFT JOIN quarters USING (band, row, col)")
def far_gaps_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return r9(V.filled_smooth(with_holes(spark, sf), ["band"], 100), "v")


ATTEMPTS = f"""a AS (
  SELECT i AS id, -30e-2 + 0.6::DOUBLE * ({drawn("'42'", "i", "'x'")}) AS x, -30e-2 + 0.6::DOUBLE * ({drawn("'42'", "i", "'y'")}) AS y FROM (SELECT unnest(range(4000)) AS i)
)"""


@query(f"""WITH {POINTS}, box AS (SELECT min(x) AS l, min(y) AS b, max(x) - min(x) AS w, max(y) - min(y) AS h FROM p)
SELECT id, round(l + w * ({drawn("'42'", "id", "'x'")}), 9) AS x, round(b + h * ({drawn("'42'", "id", "'y'")}), 9) AS y FROM p, box""")
def random_points(spark: SparkSession, sf: str) -> DataFrame:
    """A place within the bounds of all points for each of them."""
    p = points(spark, sf)
    box = p.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    return r9(N.random_places(p.select("id"), 42, box[0], box[2], box[1], box[3]), "x", "y")


@query(f"""WITH {CELLS}, {ATTEMPTS}, ok AS (
  SELECT a.id, a.x, a.y, floor((20e-2 - a.y) / 1e-2)::BIGINT AS row, floor((a.x - (-15e-2)) / 1e-2)::BIGINT AS col FROM a
), kept AS (
  SELECT ok.id, ok.x, ok.y FROM ok JOIN w USING (row, col) WHERE {VALID} AND ({CROSSINGS.replace("> y", "> ok.y").replace("AND x <", "AND ok.x <").replace("(y -", "(ok.y -")}) % 2 = 1
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.label = 0 AND sqrt((ok.x - p.x) * (ok.x - p.x) + (ok.y - p.y) * (ok.y - p.y)) <= 2e-2)
)
SELECT id, round(x, 9) AS x, round(y, 9) AS y, rn FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM kept) WHERE rn <= 150""")
def accepted_candidates(spark: SparkSession, sf: str) -> DataFrame:
    _, r, g = held(spark, sf)
    draws = N.random_points(spark, 4000, 42, -0.3, -0.3, 0.3, 0.3)
    ok = L.with_valid_factors(draws, r, g, BANDS).where(G.inside(F.col("x"), F.col("y"), RING)).select("id", "x", "y")
    ok = G.outside_radius(ok, points(spark, sf).where("label = 0"), 0.02)
    return r9(N.first_accepted(draws, ok, 150), "x", "y")


@query(f"""WITH {CELLS}, real AS (SELECT row, col FROM r GROUP BY ALL HAVING min(v) > -9999), inner_cells AS (SELECT row, col, row * 96 + col AS id FROM real, size WHERE row >= 2 AND row + 2 <= n AND col >= 2 AND col + 2 <= 96),
q AS (
  SELECT k.id, 1 - avg(CASE WHEN w.f0 IS NOT NULL AND {VALID} THEN 1 ELSE 0 END) AS ratio
  FROM inner_cells k, (SELECT unnest(range(-2, 2)) AS i), (SELECT unnest(range(-2, 2)) AS j)
  LEFT JOIN w ON w.row = k.row + i AND w.col = k.col + j GROUP BY k.id
), s AS (SELECT row, col, ratio, row_number() OVER (ORDER BY md5(concat_ws('|', '9', id::VARCHAR)), id) AS rn FROM inner_cells JOIN q USING (id) WHERE ratio <= 0.25)
SELECT row, col, round(ratio, 9) AS ratio FROM s WHERE rn <= 200""")
def interior_centres(spark: SparkSession, sf: str) -> DataFrame:
    r = pixels(spark, sf)
    return r9(N.interior_centres(r, grid(r), 4, BANDS, 0.25, 200, 9), "ratio")


def interior_sql(size: int, lacks: str, centre: str, most: float, n: int, seed: int) -> str:
    """Windows of a size by joining each cell with all of its window's cells."""
    half = size // 2
    return f"""WITH {CELLS}, every AS (SELECT row, col, {lacks} AS lacks, {centre} AS own
  FROM (SELECT row, col FROM (SELECT unnest(range(n)) AS row FROM size), (SELECT unnest(range(96)) AS col)) LEFT JOIN w USING (row, col)
), along AS (
  SELECT a.row, a.col, a.own, sum(b.lacks) AS s FROM every a JOIN every b ON b.row = a.row AND b.col BETWEEN a.col - {half} AND a.col + {half - 1}
  WHERE a.col BETWEEN {half} AND {96 - half} GROUP BY ALL
), q AS (
  SELECT a.row, a.col, a.own, sum(b.s) / {size * size}::DOUBLE AS ratio FROM along a JOIN along b ON b.col = a.col AND b.row BETWEEN a.row - {half} AND a.row + {half - 1}, size
  WHERE a.row >= {half} AND a.row + {half} <= n GROUP BY ALL
), s AS (SELECT row, col, ratio, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', (row * 96 + col)::VARCHAR)), row * 96 + col) AS rn FROM q WHERE own AND ratio <= {most})
SELECT row, col, round(ratio, 9) AS ratio FROM s WHERE rn <= {n}"""


FULL = f"coalesce({VALID}, false)"
PART = "coalesce((f0 <> -9999)::INT, 0) + coalesce((f1 <> -9999)::INT, 0) + coalesce((f2 <> -9999)::INT, 0) + coalesce((f3 <> -9999)::INT, 0)"


@query(interior_sql(32, f"(NOT {FULL})::INT", FULL, 0.25, 300, 4))
def interior_centres_wide(spark: SparkSession, sf: str) -> DataFrame:
    r = pixels(spark, sf)
    return r9(N.interior_centres(r, grid(r), 32, BANDS, 0.25, 300, 4), "ratio")


@query(interior_sql(32, f"(4 - ({PART})) / 4.0::DOUBLE", "true", 0.0625, 500, 5))
def interior_centres_by_share(spark: SparkSession, sf: str) -> DataFrame:
    r = pixels(spark, sf)
    return r9(N.interior_centres(r, grid(r), 32, BANDS, 0.0625, 500, 5, "share", False), "ratio")


@query(f"""WITH {PIXELS}, pool AS (SELECT row * 96 + col AS id FROM r WHERE band = 0 AND v <> -9999),
k AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', '5', id::VARCHAR)), id) AS n FROM pool),
d AS (SELECT i AS draw, (floor(({drawn("'5'", "i", "'pool'")}) * (SELECT count(*) FROM pool)) + 1)::BIGINT AS n FROM (SELECT unnest(range(3000)) AS i))
SELECT draw, id FROM d JOIN k USING (n)""")
def pixels_with_replacement(spark: SparkSession, sf: str) -> DataFrame:
    pool = pixels(spark, sf).where((F.col("band") == 0) & (F.col("v") != S.NODATA)).select((F.col("row") * COLS + F.col("col")).alias("id"))
    return N.drawn_with_replacement(pool, "id", 3000, 5).select("draw", "id")


JITTER = f"""j AS (
  SELECT id, k AS j, x, y, 2e-2 * sqrt({drawn("'42'", "id", "k", "'r'")}) AS r, 2 * 3.141592653589793::DOUBLE * ({drawn("'42'", "id", "k", "'a'")}) AS t
  FROM p, (SELECT unnest(range(4)) AS k)
)"""


@query(f"WITH {POINTS}, {JITTER} SELECT id, j, round(x + CASE WHEN j = 0 THEN 0 ELSE r * cos(t) END, 9) AS x, round(y + CASE WHEN j = 0 THEN 0 ELSE r * sin(t) END, 9) AS y FROM j")
def jittered_centres(spark: SparkSession, sf: str) -> DataFrame:
    return r9(G.jitter(points(spark, sf).drop("label"), 4, 0.02, 42).select("id", "j", "x", "y"), "x", "y")


@query(f"WITH {CELLS} SELECT id, row, col FROM c WHERE label <> 0 AND (row, col) NOT IN (SELECT (row, col) FROM c WHERE label = 0)")
def candidates_off_positives(spark: SparkSession, sf: str) -> DataFrame:
    p, _, g = held(spark, sf)
    cells = L.with_cells(points(spark, sf), g)
    return N.off_cells(cells.where("label <> 0"), cells.where("label = 0")).select("id", "row", "col")


@query(f"WITH {CELLS} SELECT id, round(-15e-2 + (col + 5e-1) * 1e-2, 9) AS cx, round(20e-2 - (row + 5e-1) * 1e-2, 9) AS cy FROM c")
def cell_centres(spark: SparkSession, sf: str) -> DataFrame:
    p, _, g = held(spark, sf)
    x, y = g.centre(F.col("row"), F.col("col"))
    return r9(L.with_cells(p, g).select("id", x.alias("cx"), y.alias("cy")), "cx", "cy")


def _utm_sql() -> str:
    """The series of ``functions.scalars.utm`` in SQL; its constants are those of WGS 84."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * n**0.5 / (1 + n)
    east = "eta" + "".join(f" + {a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    north = "xi" + "".join(f" + {a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    return f"""WITH {POINTS}, a AS (SELECT id, radians(10 * x - 2) AS lam, sin(radians(38 + 10 * y)) AS s FROM p),
t AS (SELECT id, lam, sinh(atanh(s) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * s)) AS t FROM a),
z AS (SELECT id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT id, round(500000 + 0.9996::DOUBLE * {radius!r}::DOUBLE * ({east}), 3) AS easting, round(0.9996::DOUBLE * {radius!r}::DOUBLE * ({north}), 3) AS northing FROM z"""


@query(_utm_sql())
def projected_points(spark: SparkSession, sf: str) -> DataFrame:
    x, y = S.utm(-83 + 10 * F.col("x"), 38 + 10 * F.col("y"))
    return r9(points(spark, sf).select("id", x.alias("easting"), y.alias("northing")), "easting", "northing", digits=3)


def files(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    step = F.when(F.col("n_nationkey") % 7 == 3, 30.000001).when(F.col("n_nationkey") % 7 == 4, 30.0000000001).otherwise(30.0)
    return n.select(
        F.col("n_name").alias("name"),
        F.when(F.col("n_regionkey") == 2, "EPSG:4326").otherwise("EPSG:32618").alias("crs"),
        F.array(step, F.lit(0.0), F.lit(500.0)).alias("transform"),
        (F.lit(100) + F.when(F.col("n_nationkey") % 5 == 1, 1).otherwise(0)).alias("width"),
        F.lit(80).alias("height"),
        F.when(F.col("n_nationkey") % 6 == 5, F.lit(None)).otherwise(F.lit(-9999.0)).alias("nodata"),
    )


@query("""WITH f AS (
  SELECT n_name AS name, CASE WHEN n_regionkey = 2 THEN 'EPSG:4326' ELSE 'EPSG:32618' END AS crs, n_nationkey % 7 = 3 AS off,
    100 + CASE WHEN n_nationkey % 5 = 1 THEN 1 ELSE 0 END AS width, n_nationkey % 6 = 5 AS bare FROM nation
), one AS (SELECT * FROM f ORDER BY name LIMIT 1)
SELECT f.name, 'crs' AS problem FROM f, one WHERE f.crs <> one.crs UNION ALL SELECT f.name, 'transform' FROM f, one WHERE f.off <> one.off
UNION ALL SELECT f.name, 'size' FROM f, one WHERE f.width <> one.width UNION ALL SELECT f.name, 'nodata' FROM f WHERE bare""")
def raster_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return R.alignment(files(spark, sf), -9999.0)


@query("""SELECT n_name AS name, CASE WHEN lower(n_name) LIKE '%i%' THEN 'class' ELSE 'plain' END AS tag FROM nation WHERE NOT contains(lower(n_name), '_1')""")
def listed_rasters(spark: SparkSession, sf: str) -> DataFrame:
    kept = R.listed(table(spark, sf, "nation").select(F.col("n_name").alias("name")), "_1")
    return kept.withColumn("tag", F.when(F.lower("name").contains("i"), "class").otherwise("plain"))


@query(f"""WITH {PIXELS}, n(band, kind) AS (VALUES (0, 'continuous'), (1, 'aspect'), (2, 'categorical'), (3, 'continuous')) SELECT kind, count(*) AS n FROM r JOIN n USING (band) GROUP BY kind""")
def pixels_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    kinds = names(spark).select("band", S.raster_kind(F.col("name")).alias("kind"))
    return pixels(spark, sf).join(F.broadcast(kinds), "band").groupBy("kind").agg(F.count("*").alias("n"))
