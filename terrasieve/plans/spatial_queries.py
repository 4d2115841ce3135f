"""Points, centres, polygons, grids and patches over the test tables: the first two numbers of
an embedding are a place, all 64 a band of 8 by 8 pixels, four vectors a patch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cluster as C
from ..operators import gaps as V
from ..operators import geo as G
from ..operators import patch as T
from ..operators import sampling as E
from ..registry import query, table
from .metric_queries import r9

POINTS = "p AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
CENTRES = [(0, -0.2, -0.2), (1, -0.2, 0.2), (2, 0.2, -0.2), (3, 0.2, 0.2)]
CENTRES_SQL = "c(k, cx, cy) AS (VALUES (0, -0.2::DOUBLE, -0.2::DOUBLE), (1, -0.2, 0.2), (2, 0.2, -0.2), (3, 0.2, 0.2))"
ASSIGNED = f"{POINTS}, {CENTRES_SQL}, a AS (SELECT id, x, y, k, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM p, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), k) = 1)"
RING = [(-0.2, -0.2), (0.2, -0.1), (0.25, 0.2), (0.0, 0.05), (-0.15, 0.2)]
GRID = "g AS (SELECT vec_id // 4 AS id, vec_id % 4 AS band, i // 8 AS row, i % 8 AS col, CASE WHEN (vec_id * 64 + i) % 17 = 0 THEN -9999.0::DOUBLE ELSE embedding[i + 1]::DOUBLE END AS v FROM embeddings, (SELECT unnest(range(64)) AS i))"
MASK = f"{GRID}, m AS (SELECT id, row, col, min(CASE WHEN v <> -9999 THEN 1 ELSE 0 END) AS m FROM g GROUP BY ALL)"
STATS = f"{MASK}, s AS (SELECT band, count(*) AS n, avg(v) AS mean, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-12)) AS sd FROM g JOIN m USING (id, row, col) WHERE m = 1 GROUP BY band)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    place = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", place(0).alias("x"), place(1).alias("y"))


def centres(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CENTRES, "k int, cx double, cy double")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    each = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    value = F.when((F.col("vec_id") * 64 + F.col("i")) % 17 == 0, S.NODATA).otherwise(F.col("e").cast("double"))
    return each.select(F.floor(F.col("vec_id") / 4).alias("id"), (F.col("vec_id") % 4).alias("band"), F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).cast("bigint").alias("col"), value.alias("v"))


def whole(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("row", "col")})


@query(f"WITH {POINTS}, r AS (SELECT id, floor((5e-1 - y) / 5e-2)::BIGINT AS row, floor((x + 5e-1) / 5e-2)::BIGINT AS col FROM p) SELECT *, row >= 0 AND row < 12 AND col >= 0 AND col < 12 AS held FROM r")
def affine_rowcol(spark: SparkSession, sf: str) -> DataFrame:
    row, col = S.row_col(F.col("x"), F.col("y"), -0.5, 0.5, 0.05, 0.05)
    return points(spark, sf).select("id", row.alias("row"), col.alias("col")).withColumn("held", F.col("row").between(0, 11) & F.col("col").between(0, 11))


@query(f"WITH {POINTS}, r AS (SELECT id, floor((5e-1 - y) / 5e-2)::BIGINT AS row, floor((x + 5e-1) / 5e-2)::BIGINT AS col FROM p) SELECT id, row - 2 AS row_start, row + 2 AS row_stop, col - 2 AS col_start, col + 2 AS col_stop FROM r")
def patch_windows(spark: SparkSession, sf: str) -> DataFrame:
    row, col = S.row_col(F.col("x"), F.col("y"), -0.5, 0.5, 0.05, 0.05)
    return points(spark, sf).select("id", *[c.alias(n) for n, c in S.patch_window(row, col, 4).items()])


@query(f"WITH {ASSIGNED} SELECT id, k, round(d2, 9) AS d2 FROM a")
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return r9(G.nearest_centre(points(spark, sf), centres(spark)).select("id", "k", "d2"), "d2")


@query(f"WITH {ASSIGNED} SELECT k, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy, count(*) AS n, round(sum(d2), 8) AS inertia FROM a GROUP BY k")
def kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    return r9(C.lloyd_step(points(spark, sf).select("id", "x", "y"), centres(spark)), "cx", "cy").withColumn("inertia", F.round("inertia", 8))


@query(f"WITH {POINTS} SELECT id FROM p a WHERE label <> 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.label = 0 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05)")
def radius_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return G.outside_radius(p.where("label <> 0").drop("label"), p.where("label = 0"), 0.05).select("id")


@query(f"""WITH {POINTS}, d AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a, p b WHERE a.label <> 0 AND b.label = 0), n AS (SELECT * FROM d WHERE d <= 0.05 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) = 1)
SELECT p.id, other, round(d, 9) AS d FROM p LEFT JOIN n USING (id) WHERE label <> 0""")
def nearest_with_cap(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return r9(G.nearest_within(p.where("label <> 0"), p.where("label = 0"), 0.05), "d")


@query(f"""WITH {POINTS}, f AS (SELECT *, label % 5 AS fold FROM p), d AS (SELECT a.fold, a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM f a JOIN f b ON a.fold <> b.fold GROUP BY ALL)
SELECT fold, count(*) AS n_test, (SELECT count(*) FROM f) - count(*) AS n_train, count(*) FILTER (d < 0.02) AS n_near, round(min(d), 9) AS least FROM d GROUP BY fold""")
def fold_dead_zone_report(spark: SparkSession, sf: str) -> DataFrame:
    return r9(G.dead_zone_report(points(spark, sf).withColumn("fold", F.col("label") % 5), "fold", 0.02), "least")


CROSSINGS = " + ".join(f"CASE WHEN ({y1}::DOUBLE > y) <> ({y2}::DOUBLE > y) AND x < ({x2 - x1}::DOUBLE * (y - {y1}::DOUBLE) / {y2 - y1}::DOUBLE + {x1}::DOUBLE) THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1], strict=True) if y1 != y2).replace("- -", "+ ")


@query(f"WITH {POINTS} SELECT id FROM p WHERE ({CROSSINGS}) % 2 = 1")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).where(G.inside(F.col("x"), F.col("y"), RING)).select("id")


@query(f"WITH {GRID} SELECT id, round(avg(CASE WHEN v = -9999 THEN 1.0 ELSE 0.0 END), 9) AS ratio FROM g GROUP BY id")
def nodata_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return r9(T.nodata_ratio(pixels(spark, sf)), "ratio")


@query(f"WITH {STATS} SELECT band, n, round(mean, 8) AS mean, round(sd, 8) AS sd FROM s")
def channel_stats_masked(spark: SparkSession, sf: str) -> DataFrame:
    g = pixels(spark, sf)
    return r9(T.band_statistics(g, T.context_mask(g)), "mean", "sd", digits=8)


@query(f"""WITH {STATS} SELECT id, band, row, col, round(CASE WHEN m = 1 THEN (v - mean) / (sd + 1e-6) ELSE 0 END, 6) AS v FROM g JOIN m USING (id, row, col) JOIN s USING (band)
UNION ALL SELECT id, 4, row, col, m::DOUBLE FROM m""")
def normalise_and_mask(spark: SparkSession, sf: str) -> DataFrame:
    g = pixels(spark, sf)
    mask = T.context_mask(g)
    return r9(T.normalised(g, mask, T.band_statistics(g, mask)), "v", digits=6)


@query(f"WITH {GRID} SELECT id, band, CASE id % 4 WHEN 1 THEN 7 - col WHEN 2 THEN 7 - row WHEN 3 THEN col ELSE row END AS row, CASE id % 4 WHEN 1 THEN row WHEN 2 THEN 7 - col WHEN 3 THEN 7 - row ELSE col END AS col, v FROM g")
def rotate_patch(spark: SparkSession, sf: str) -> DataFrame:
    return whole(T.rotated(pixels(spark, sf), F.col("id") % 4, 8))


@query(f"WITH {GRID}, o(place, tile) AS (VALUES (0, 2), (1, 0), (2, 3), (3, 1)) SELECT id, band, place // 2 * 4 + row % 4 AS row, place % 2 * 4 + col % 4 AS col, v FROM g JOIN o ON tile = row // 4 * 2 + col // 4")
def jigsaw_permute(spark: SparkSession, sf: str) -> DataFrame:
    return whole(T.tiles_permuted(pixels(spark, sf), [2, 0, 3, 1], 2, 8))


@query(f"WITH {GRID} SELECT id, band, CASE WHEN row < 6 THEN row + 2 ELSE row - 6 END AS row, col, v FROM g")
def strip_permute(spark: SparkSession, sf: str) -> DataFrame:
    return whole(T.strips_permuted(pixels(spark, sf), [2, 0, 1], 8))


@query(f"""WITH {GRID}, b AS (SELECT id, block, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws('|', '42', id::VARCHAR, block::VARCHAR)), block) <= 2 THEN 1 ELSE 0 END AS masked FROM (SELECT DISTINCT id FROM g), (SELECT unnest(range(4)) AS block))
SELECT id, round(sum(v * v * masked) / greatest(sum(masked), 1), 4) AS mse FROM g JOIN b USING (id) WHERE block = row // 4 * 2 + col // 4 GROUP BY id""")
def block_mask_mse(spark: SparkSession, sf: str) -> DataFrame:
    g = pixels(spark, sf)
    blocks = T.block_mask(g.select("id").distinct(), 8, 4, 0.5, 42)
    return r9(T.masked_error(g, F.lit(0.0), blocks, 8, 4), "mse", digits=4)


@query(f"WITH {GRID} SELECT id, band, row, col, CASE WHEN band = 2 THEN 0.0 ELSE v END AS v, CASE WHEN band = 2 THEN v END AS target FROM g")
def channel_mask(spark: SparkSession, sf: str) -> DataFrame:
    return T.band_masked(pixels(spark, sf), 2)


@query("""WITH z AS (SELECT vec_id // 10 AS batch, vec_id % 10 // 2 AS pair, vec_id % 2 AS side, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
s AS (SELECT a.batch, a.pair, a.side, b.pair AS pair2, list_cosine_similarity(a.z, b.z) / 0.2 AS s FROM z a JOIN z b ON a.batch = b.batch AND (a.pair <> b.pair OR a.side <> b.side))
SELECT batch, round(avg(loss), 6) AS loss FROM (SELECT batch, pair, side, ln(sum(exp(s))) - max(s) FILTER (pair = pair2) AS loss FROM s GROUP BY ALL) GROUP BY batch""")
def nt_xent(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    z = table(spark, sf, "embeddings").select(F.floor(v / 10).alias("batch"), F.floor(v % 10 / 2).alias("pair"), (v % 2).alias("side"), F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    return r9(T.contrastive_loss(z), "loss", digits=6)


@query(f"""WITH {GRID.replace("g AS (", "g AS MATERIALIZED (", 1)}, n AS (
  SELECT a.id, a.band, a.row, a.col, arg_min(k.v, {{d2: (a.row - k.row) * (a.row - k.row) + (a.col - k.col) * (a.col - k.col), row: k.row, col: k.col}}) AS fill
  FROM g a JOIN g k ON k.id = a.id AND k.band = a.band WHERE a.v = -9999 AND k.v <> -9999 GROUP BY ALL
)
SELECT id, band, row, col, coalesce(fill, g.v) AS v FROM g LEFT JOIN n USING (id, band, row, col)""")
def nearest_valid_fill(spark: SparkSession, sf: str) -> DataFrame:
    return V.filled_nearest(pixels(spark, sf), ["id", "band"])


@query(f"WITH {GRID}, b AS (SELECT id, row, col, v, 0.9 * v AS rebuilt FROM g WHERE band = 2) SELECT id, round(avg((rebuilt - v) * (rebuilt - v)), 4) AS mse FROM b GROUP BY id")
def masked_band_error(spark: SparkSession, sf: str) -> DataFrame:
    return r9(T.band_error(T.band_masked(pixels(spark, sf), 2), F.col("target") * 0.9, 2), "mse", digits=4)


@query(f"""WITH {GRID}, b AS (SELECT id, block, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws('|', '42', id::VARCHAR, block::VARCHAR)), block) <= 2 THEN 1 ELSE 0 END AS masked FROM (SELECT DISTINCT id FROM g), (SELECT unnest(range(4)) AS block))
SELECT id, band, row, col, v * (1 - masked) AS shown, round(abs(0.9 * v - v), 9) AS error FROM g JOIN b USING (id) WHERE block = row // 4 * 2 + col // 4""")
def masked_panels(spark: SparkSession, sf: str) -> DataFrame:
    g = pixels(spark, sf)
    blocks = T.block_mask(g.select("id").distinct(), 8, 4, 0.5, 42)
    return r9(T.panels(g, F.col("v") * 0.9, blocks, 8, 4), "error")


@query(f"""WITH {GRID}, f AS (SELECT id, band, row, 7 - col AS col, v FROM g), d AS (SELECT id, avg(abs(g.v - f.v)) AS d FROM g JOIN f USING (id, band, row, col) GROUP BY id)
SELECT id, round(d, 6) AS mean_difference, d > 1e-6 AS differ FROM d""")
def views_differ(spark: SparkSession, sf: str) -> DataFrame:
    g = pixels(spark, sf)
    return r9(T.view_difference(g, T.flipped(g, 8, across=True)), "mean_difference", digits=6)


@query(f"""WITH {GRID}, s AS (SELECT row, col, 1 + row * (5 - 1) / 7.0::DOUBLE AS y, 2 + col * (5 - 1) / 7.0::DOUBLE AS x FROM (SELECT unnest(range(8)) AS row), (SELECT unnest(range(8)) AS col)),
q AS (SELECT row, col, least(floor(y)::BIGINT, 4) AS y0, least(floor(x)::BIGINT, 5) AS x0, y, x FROM s)
SELECT a.id, a.band, q.row, q.col, round((1 - (y - y0)) * ((1 - (x - x0)) * a.v + (x - x0) * b.v) + (y - y0) * ((1 - (x - x0)) * c.v + (x - x0) * d.v), 6) AS v FROM q
JOIN g a ON a.row = y0 AND a.col = x0 JOIN g b ON b.id = a.id AND b.band = a.band AND b.row = y0 AND b.col = x0 + 1
JOIN g c ON c.id = a.id AND c.band = a.band AND c.row = y0 + 1 AND c.col = x0 JOIN g d ON d.id = a.id AND d.band = a.band AND d.row = y0 + 1 AND d.col = x0 + 1""")
def cropped_and_resized(spark: SparkSession, sf: str) -> DataFrame:
    return r9(T.crop_resized(pixels(spark, sf), 1, 2, 5, 8), "v", digits=6)


NOISE = "(('0x' || substr(md5(concat_ws('|', '6', id::VARCHAR, band::VARCHAR, row::VARCHAR, col::VARCHAR, '{}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"""WITH {GRID} SELECT id, band, row, col, round(CASE WHEN ('0x' || substr(md5(concat_ws('|', '6', id::VARCHAR, band::VARCHAR, 'drop')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2::DOUBLE THEN 0
ELSE v + 0.05 * sqrt(-2 * ln(1 - {NOISE.format("a")})) * cos(2 * 3.141592653589793::DOUBLE * {NOISE.format("b")}) END, 6) AS v FROM g""")
def noised_patch(spark: SparkSession, sf: str) -> DataFrame:
    return r9(T.noised(pixels(spark, sf), 0.05, 0.2, 6), "v", digits=6)


@query(f"""WITH {POINTS}, k AS (SELECT id, x, y, label % 4 AS k0 FROM p), c AS (SELECT k0 AS k, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM k GROUP BY k0)
SELECT k, round(cx, 9) AS cx, round(cy, 9) AS cy, n FROM c""")
def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).withColumn("k", F.col("label") % 4).withColumn("d2", F.lit(0.0))
    return r9(C.centroids(p).select("k", "cx", "cy", "n"), "cx", "cy")


@query(f"""WITH {ASSIGNED}, s AS (SELECT label AS seed, sum(d2) AS inertia FROM a JOIN p USING (id) GROUP BY label) SELECT seed, round(inertia, 8) AS inertia FROM s ORDER BY s.inertia, seed LIMIT 1""")
def lowest_inertia(spark: SparkSession, sf: str) -> DataFrame:
    each = G.nearest_centre(points(spark, sf), centres(spark)).groupBy(F.col("label").alias("seed")).agg(F.sum("d2").alias("inertia"))
    return C.lowest(each).withColumn("inertia", F.round("inertia", 8))


@query()
def kmeans_search(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds 0 to 100 with 20 restarts each: a row per seed, the best marked."""
    return C.seed_search(points(spark, sf).select("id", "x", "y"), 4, range(101))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT i AS seed, n AS points, true AS sizes_add_up, true AS ratio_of_sizes, true AS best_is_lowest, 1 AS n_best
FROM n, (SELECT unnest(range(101)) AS i)""")
def kmeans_search_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the search's diagnostics, seed by seed."""
    found = kmeans_search(spark, sf)
    sizes = F.map_values("sizes")
    lowest = found.where("usable").agg(F.min("inertia").alias("lowest"), F.count_if("best").alias("n_best"))
    total = points(spark, sf).agg(F.count("*").alias("points"))
    add_up = F.aggregate(sizes, F.lit(0).cast("long"), lambda t, n: t + n) == F.col("points")
    ratio = (F.array_min(sizes) == F.col("least_size")) & (F.array_max(sizes) == F.col("most_size")) & (F.col("ratio") == F.col("most_size") / F.col("least_size"))
    rows = found.join(F.broadcast(lowest.join(total, F.lit(True))), F.lit(True))  # one row
    best = ~F.col("best") | (F.col("usable") & (F.col("inertia") == F.col("lowest")))
    return rows.select("seed", "points", add_up.alias("sizes_add_up"), ratio.alias("ratio_of_sizes"), best.alias("best_is_lowest"), "n_best")


@query()
def capacity_assignment(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).select("id", "x", "y")
    return C.assign_capacities(p, centres(spark), E.capacities(p.count(), 4))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT i AS k, n // 4 + (i < n % 4)::BIGINT AS n, 0.0::DOUBLE AS gap, true AS settled FROM n, (SELECT unnest(range(4)) AS i)""")
def capacity_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the clusters, how far the total is above the proven bound, and that no exchange of
    two points lowers it."""
    p = points(spark, sf).select("id", "x", "y")
    found, total, bound = C.exact_capacities(p, centres(spark), E.capacities(p.count(), 4))
    sizes = found.groupBy("k").agg(F.count("*").alias("n"))
    placed = found.join(p, "id").join(F.broadcast(centres(spark).withColumnRenamed("k", "other")), F.col("k") != F.col("other"))
    loss = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) - F.col("d2")
    least = placed.groupBy("k", "other").agg(F.min(loss).alias("loss"))
    back = least.select(F.col("k").alias("other"), F.col("other").alias("k"), F.col("loss").alias("back"))
    settled = least.join(back, ["k", "other"]).groupBy("k").agg((F.min(F.col("loss") + F.col("back")) >= -1e-9).alias("settled"))
    return sizes.join(settled, "k").withColumn("gap", F.round(F.lit(total - bound), 8) + 0.0).select("k", "n", "gap", "settled")
