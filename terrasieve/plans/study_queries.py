"""Reports of studies over the test tables: many metrics at once, fixed classes, clusters that are
carried on, flags and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as N
from ..operators import cluster as C
from ..operators import geo as G
from ..operators import metrics as M
from ..operators import patch as T
from ..operators import quality as Q
from ..operators import report as R
from ..registry import query, table
from .metric_queries import RUNS, r9, runs
from .raster_queries import drawn
from .spatial_queries import ASSIGNED, CENTRES_SQL, GRID, POINTS, centres, pixels, points, whole

METRICS = [f"m{i}" for i in range(8)]
MEASURED = f"""v AS (SELECT label AS method, vec_id % 5 AS fold, {", ".join(f"embedding[{i + 1}]::DOUBLE AS m{i}" for i in range(8))} FROM embeddings),
f AS (SELECT method, fold, {", ".join(f"avg({m}) AS {m}" for m in METRICS)} FROM v GROUP BY ALL)"""
FIVE = ("mean", "sd", "median", "min", "max")
SQL_OF = {"mean": "avg", "sd": "stddev_samp", "median": "median", "min": "min", "max": "max"}


@query(f"""WITH {MEASURED} SELECT method, {", ".join(f"round({SQL_OF[s]}({m}), 8) AS {s}_{m}" for m in METRICS for s in FIVE)},
arg_min(fold, {{m: m0, fold: fold}}) AS worst_fold_id, arg_min(fold, {{m: -m0, fold: fold}}) AS best_fold_id FROM f GROUP BY method""")
def eight_metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Five statistics of eight metrics over folds, and the folds where the first is worst and best."""
    e = table(spark, sf, "embeddings")
    rows = e.select(F.col("label").alias("method"), (F.col("vec_id") % 5).alias("fold"), *[F.get("embedding", F.lit(i)).cast("double").alias(m) for i, m in enumerate(METRICS)])
    return r9(R.wide_summary(rows, "method", "fold", METRICS), *[f"{s}_{m}" for m in METRICS for s in FIVE], digits=8)


@query(f"""WITH {RUNS} SELECT method, fraction, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sd, count(value) AS n, round(avg(train_n), 8) AS mean_train_n
FROM (SELECT method, (1 + event_id % 4) / 4.0::DOUBLE AS fraction, value, user_id * 10 AS train_n FROM v) GROUP BY method, fraction""")
def label_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs(spark, sf).select("method", ((1 + F.col("event_id") % 4) / 4).alias("fraction"), "value", (F.col("user_id") * 10).alias("train_n"))
    return r9(R.efficiency(rows, "method", "fraction", "value", "train_n"), "mean", "sd", "mean_train_n", digits=8)


@query("""WITH p AS (SELECT user_id % 7 AS true_class, event_id % 5 AS predicted FROM events WHERE user_id % 7 <> 4), c AS (SELECT unnest([0, 2, 4, 6, 9]) AS k),
n AS (SELECT true_class, predicted, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT a.k AS true_class, b.k AS predicted, coalesce(n, 0) AS n FROM c a CROSS JOIN c b LEFT JOIN n ON n.true_class = a.k AND n.predicted = b.k)
SELECT true_class, predicted, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY true_class), 0), 0), 9) AS share FROM g""")
def confusion_of_fixed_classes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("user_id % 7 <> 4")
    pairs = e.select((F.col("user_id") % 7).cast("int").alias("true_class"), (F.col("event_id") % 5).cast("int").alias("predicted"))
    return r9(M.fixed_confusion(pairs, "true_class", "predicted", [0, 2, 4, 6, 9]), "share")


@query(f"""WITH {POINTS}, k AS (SELECT id, x, y, label % 4 AS k FROM p WHERE label < 6), c AS (SELECT k, avg(x) AS cx, avg(y) AS cy FROM k GROUP BY k)
SELECT id, k, true AS fitted FROM k UNION ALL SELECT id, arg_min(c.k, {{d: (x - cx) * (x - cx) + (y - cy) * (y - cy), k: c.k}}), false FROM p, c WHERE label >= 6 GROUP BY id""")
def clusters_carried_on(spark: SparkSession, sf: str) -> DataFrame:
    """Points that a clustering was fitted on keep their cluster, others go to the nearest middle."""
    p = points(spark, sf)
    return C.assigned_clusters(p.where("label < 6").withColumn("k", F.col("label") % 4), p.where("label >= 6"))


@query(f"WITH {ASSIGNED} SELECT id, k AS fold FROM a")
def spatial_folds(spark: SparkSession, sf: str) -> DataFrame:
    """The fold of a sample is its cluster."""
    return G.nearest_centre(points(spark, sf).select("id", "x", "y"), centres(spark)).select("id", F.col("k").alias("fold"))


@query("SELECT count(*) AS n, 5::BIGINT AS blocks, 0::BIGINT AS strays FROM embeddings")
def spatial_block_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of the best run: how many there are, and points nearer to another block's middle."""
    found = C.spatial_blocks(points(spark, sf).select("id", "x", "y"), 5)
    middles = found.groupBy("block").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).withColumnRenamed("block", "k")
    # Runs end when no centre moves by more than a ten-thousandth, so ties within that don't count.
    near = G.nearest_centre(found, middles).join(F.broadcast(middles.withColumnsRenamed({"k": "block", "cx": "ox", "cy": "oy"})), "block")
    own = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return near.agg(F.count("*").alias("n"), F.count_distinct("block").alias("blocks"), F.count_if(own > F.sqrt("d2") + 5e-4).alias("strays"))


NEGATIVES = """r AS (SELECT CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 1 ELSE event_id END AS id, CASE WHEN event_id % 31 = 0 THEN -9999.0 ELSE value END AS f0, user_id::DOUBLE AS f1,
  (event_id % 13 = 0)::INTEGER AS label, event_id % 50 AS times, (event_id % 120) / 100.0::DOUBLE AS ratio, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 0.5::DOUBLE END AS mean_p FROM events)"""


@query(f"""WITH {NEGATIVES} SELECT 'id is there' AS rule, count(*) FILTER (id IS NULL) AS n FROM r UNION ALL SELECT 'label is 0', count(*) FILTER (label <> 0) FROM r
UNION ALL SELECT 'scored at least once', count(*) FILTER (times <= 0) FROM r UNION ALL SELECT 'f0 is real', count(*) FILTER (f0 = -9999) FROM r UNION ALL SELECT 'f1 is real', 0 FROM (SELECT 1)
UNION ALL SELECT 'ratio is from 0 to 1', count(*) FILTER (ratio > 1) FROM r UNION ALL SELECT 'mean_p is from 0 to 1', count(*) FILTER (mean_p IS NULL) FROM r
UNION ALL SELECT 'id is unique', count(*) FROM (SELECT id FROM r WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)""")
def reliable_negative_rules(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.when(i % 97 == 0, None).when(i % 89 == 0, 1).otherwise(i).alias("id"),
        F.when(i % 31 == 0, -9999.0).otherwise(F.col("value")).alias("f0"),
        F.col("user_id").cast("double").alias("f1"),
        (i % 13 == 0).cast("int").alias("label"),
        (i % 50).alias("times"),
        (i % 120 / 100).alias("ratio"),
        F.when(i % 7 != 0, 0.5).alias("mean_p"),
    )
    return Q.negative_rules(rows, "id", ["f0", "f1"])


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS grp, o_custkey % 5 AS fold, (o_orderstatus = 'F')::INTEGER AS label FROM orders), f AS (SELECT fold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM r GROUP BY fold),
t AS (SELECT (SELECT count(*) = 5 AND bool_and(p > 0 AND q > 0) FROM f) AS folds_whole, (SELECT count(*) = 0 FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1)) AS ids_once,
  (SELECT count(*) = 0 FROM (SELECT grp FROM r GROUP BY grp HAVING count(DISTINCT fold) > 1)) AS groups_whole) SELECT *, folds_whole AND ids_once AND groups_whole AS passed FROM t""")
def flat_cv_flag(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), (F.col("o_custkey") % 5).alias("fold"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return Q.flat_folds_pass(rows, "id", "grp", "fold", "label", 5)


@query("""WITH v AS (SELECT event_type AS model_display_name, event_id, value FROM events) SELECT * FROM v WHERE model_display_name = 'view' ORDER BY event_id LIMIT 1""")
def reference_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_type").alias("model_display_name"), "event_id", "value")
    return R.reference_row(rows, "model_display_name", "view", "event_id")


@query("""WITH v AS (SELECT user_id % 20 AS seed, event_type AS arm, CASE event_id % 4 WHEN 0 THEN ' 1e-3 ' WHEN 1 THEN 'scratch' WHEN 2 THEN '0.0005' ELSE NULL END AS rate, event_id, value FROM events),
c AS (SELECT seed, arm, try_cast(trim(rate) AS DOUBLE) AS rate, event_id, value FROM v)
SELECT seed, arm, rate, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM c GROUP BY seed, arm, rate""")
def coerced_fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("event_id") % 4
    rate = F.when(part == 0, " 1e-3 ").when(part == 1, "scratch").when(part == 2, "0.0005")
    rows = table(spark, sf, "events").select((F.col("user_id") % 20).alias("seed"), F.col("event_type").alias("arm"), rate.alias("rate"), "event_id", "value")
    return R.coerced_metrics(rows, ["seed", "arm"], "rate", ["event_id"])


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || ':' || n::VARCHAR, ',' ORDER BY event_type) AS counts FROM n GROUP BY user_id""")
def count_maps(spark: SparkSession, sf: str) -> DataFrame:
    found = R.count_map(table(spark, sf, "events"), "user_id", "event_type")
    return found.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("counts"))


@query(f"""WITH {GRID}, d AS (SELECT id, floor(({drawn("'3'", "id", "'task'")}) * 4)::INTEGER AS task FROM (SELECT DISTINCT id FROM g))
SELECT id, task, band, CASE task WHEN 1 THEN 7 - col WHEN 2 THEN 7 - row WHEN 3 THEN col ELSE row END AS row, CASE task WHEN 1 THEN row WHEN 2 THEN 7 - col WHEN 3 THEN 7 - row ELSE col END AS col, v FROM g JOIN d USING (id)""")
def rotation_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each patch turned by the quarter that is drawn as its label."""
    g = pixels(spark, sf)
    tasks = N.task_labels(g.select("id").distinct(), "id", 4, 3)
    return whole(T.rotated(g.join(tasks, "id"), F.col("task"), 8)).select("id", "task", "band", "row", "col", "v")


@query(f"""WITH {POINTS}, {CENTRES_SQL}, d AS (SELECT id, k, round_even(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 3) AS d, round_even(x * 100, 0)::BIGINT AS class FROM p, c) SELECT id, k, d, class FROM d""")
def rounded_values(spark: SparkSession, sf: str) -> DataFrame:
    """Distances to three decimals and classes to whole numbers, halves to even."""
    rows = points(spark, sf).crossJoin(F.broadcast(centres(spark)))  # a row per centre
    d = F.bround(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), 3)
    return rows.select("id", "k", d.alias("d"), F.rint(F.col("x") * 100).cast("bigint").alias("class"))
