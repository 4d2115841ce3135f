"""Metrics and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M
from ..operators import report as R
from ..registry import query, table

SCORED = "j AS (SELECT d.lang, d.doc_id, CAST(d.n_chars AS DOUBLE) AS s, l.quality AS y FROM documents d JOIN labels l USING (doc_id))"
UNIT = "j AS (SELECT d.lang, d.doc_id, least(d.n_chars / 20000.0, 1.0) AS s, l.quality AS y FROM documents d JOIN labels l USING (doc_id))"
RUNS = "v AS (SELECT event_type AS method, user_id % 5 AS seed, day(ts) % 5 AS fold, value, user_id, event_id, ts FROM events)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    return table(spark, sf, "documents").select("lang", "doc_id", F.col("n_chars").cast("double").alias("s")).join(labels, "doc_id")


def unit(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).withColumn("s", F.least(F.col("s") / 20000.0, F.lit(1.0)))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 5).alias("seed"), (F.dayofmonth("ts") % 5).alias("fold"), "value", "user_id", "event_id", "ts")


def r9(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {SCORED}, g AS (SELECT lang, sum(y) AS n_pos, sum(1 - y) AS n_neg FROM j GROUP BY lang),
p AS (SELECT a.lang, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS auc FROM j a JOIN j b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY a.lang)
SELECT lang, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(auc, 9) AS auc FROM g LEFT JOIN p USING (lang)""")
def auc_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.roc_auc(scored(spark, sf), ["lang"]), "auc")


@query(f"""WITH {SCORED}, o AS (SELECT lang, y, row_number() OVER w AS k, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM j WINDOW w AS (PARTITION BY lang ORDER BY s DESC, doc_id))
SELECT lang, round(sum(CASE WHEN y = 1 THEN hits / k END) / nullif(sum(y), 0), 9) AS ap FROM o GROUP BY lang""")
def average_precision_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.average_precision(scored(spark, sf), ["lang"], "doc_id"), "ap")


@query(f"""WITH {SCORED}, t AS (SELECT DISTINCT lang, s FROM j), n AS (SELECT lang, sum(y) AS p, sum(1 - y) AS q FROM j GROUP BY lang)
SELECT t.lang, 'score' AS kind, t.s AS threshold, round(coalesce(sum(CASE WHEN j.s >= t.s THEN j.y END) / nullif(any_value(p), 0), 0), 9) AS tpr, round(coalesce(sum(CASE WHEN j.s >= t.s THEN 1 - j.y END) / nullif(any_value(q), 0), 0), 9) AS fpr
FROM t JOIN j ON t.lang = j.lang JOIN n ON n.lang = t.lang GROUP BY t.lang, t.s
UNION ALL SELECT lang, 'none', NULL, 0.0, 0.0 FROM n UNION ALL SELECT lang, 'all', NULL, 1.0, 1.0 FROM n""")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.roc_points(scored(spark, sf), ["lang"]), "tpr", "fpr")


@query(f"""WITH {SCORED}, t AS (SELECT DISTINCT lang, s FROM j), n AS (SELECT lang, sum(y) AS p FROM j GROUP BY lang)
SELECT t.lang, 'score' AS kind, t.s AS threshold, round(sum(CASE WHEN j.s >= t.s THEN j.y END) / count(*) FILTER (j.s >= t.s), 9) AS precision, round(coalesce(sum(CASE WHEN j.s >= t.s THEN j.y END) / nullif(any_value(p), 0), 0), 9) AS recall
FROM t JOIN j ON t.lang = j.lang JOIN n ON n.lang = t.lang GROUP BY t.lang, t.s UNION ALL SELECT lang, 'none', NULL, 1.0, 0.0 FROM n""")
def pr_points(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.pr_points(scored(spark, sf), ["lang"]), "precision", "recall")


COUNTS = "count(*) FILTER (y = 0 AND s < 0.1) AS tn, count(*) FILTER (y = 0 AND s >= 0.1) AS fp, count(*) FILTER (y = 1 AND s < 0.1) AS fn, count(*) FILTER (y = 1 AND s >= 0.1) AS tp"


@query(f"WITH {UNIT} SELECT lang, {COUNTS} FROM j GROUP BY lang")
def confusion_at_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(unit(spark, sf), ["lang"], 0.1)


@query(f"""WITH {UNIT}, c AS (SELECT lang, {COUNTS} FROM j GROUP BY lang),
p AS (SELECT a.lang, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS auc FROM j a JOIN j b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY a.lang),
o AS (SELECT lang, y, row_number() OVER w AS k, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM j WINDOW w AS (PARTITION BY lang ORDER BY s DESC, doc_id)),
ap AS (SELECT lang, sum(CASE WHEN y = 1 THEN hits / k END) / nullif(sum(y), 0) AS ap FROM o GROUP BY lang)
SELECT lang, tn, fp, fn, tp, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(auc, 9) AS auc, round(ap, 9) AS ap FROM c LEFT JOIN p USING (lang) LEFT JOIN ap USING (lang)""")
def binary_metrics_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return r9(M.binary_metrics(unit(spark, sf), ["lang"], "doc_id", 0.1), "accuracy", "precision", "recall", "f1", "auc", "ap")


@query(f"""WITH {UNIT}, t AS (SELECT DISTINCT lang, s AS t FROM j UNION SELECT DISTINCT lang, x FROM j, (VALUES (0.0), (0.5), (1.0)) e(x)), g AS (SELECT lang, sum(y) AS p, count(*) AS n FROM j GROUP BY lang),
f AS (SELECT t.lang, t.t, round(coalesce(2 * count(*) FILTER (j.s >= t.t AND j.y = 1) / nullif(count(*) FILTER (j.s >= t.t) + any_value(p), 0), 0), 8) AS f1 FROM t JOIN j ON t.lang = j.lang JOIN g ON g.lang = t.lang GROUP BY t.lang, t.t),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, abs(t - 0.5), t) AS k FROM f)
SELECT lang, CASE WHEN p = 0 OR p = n THEN 0.5 ELSE t END AS threshold, CASE WHEN p > 0 AND p < n THEN f1 END AS f1 FROM r JOIN g USING (lang) WHERE k = 1""")
def best_f1_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return M.best_f1(unit(spark, sf), ["lang"])


@query("""WITH v AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label AS class, i, avg(x) AS m FROM v GROUP BY label, i),
d AS (SELECT v.vec_id, v.label, c.class, -sum((x - m) * (x - m)) AS logit FROM v JOIN c ON v.i = c.i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(logit, 12) DESC, class) AS place FROM d)
SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN place <= k THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM r, (VALUES (1), (3), (5)) t(k) WHERE class = label GROUP BY k""")
def topk_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    means = vectors.select("label", F.posexplode("z").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    # A row per class.
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c")).withColumnRenamed("label", "class")
    far = F.aggregate(F.zip_with("z", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    logits = vectors.crossJoin(F.broadcast(centres)).select("vec_id", "label", "class", F.round(-far, 12).alias("logit"))
    return r9(M.top_k_accuracy(logits, "vec_id", "class", "label", "logit", (1, 3, 5)), "accuracy")


@query("""WITH p AS (SELECT user_id % 7 AS true_class, event_id % 7 AS predicted FROM events), top AS (SELECT true_class AS c FROM p GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 5), g AS (SELECT a.c AS true_class, b.c AS predicted FROM top a, top b),
n AS (SELECT true_class, predicted, count(*) AS n FROM p GROUP BY ALL)
SELECT g.true_class, g.predicted, coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY g.true_class), 0), 0), 9) AS share FROM g LEFT JOIN n ON g.true_class = n.true_class AND g.predicted = n.predicted""")
def confusion_row_normalised(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "events").select((F.col("user_id") % 7).alias("true_class"), (F.col("event_id") % 7).alias("predicted"))
    return r9(M.normalised_confusion(pairs, "true_class", "predicted", 5), "share")


ROLLED = f"""{RUNS}, f AS (SELECT method, seed, fold, avg(value) AS m FROM v GROUP BY ALL), s AS (SELECT method, seed, avg(m) AS mean, min(m) AS worst, max(m) AS best, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT method, count(*) AS n_seeds, CAST(sum(n) AS BIGINT) AS n_fold_rows, avg(mean) AS mean_seed, stddev_samp(mean) AS sd_seed, stddev_pop(mean) AS sd_seed_pop, min(worst) AS worst_fold, max(best) AS best_fold FROM s GROUP BY method)"""


def rolled(spark: SparkSession, sf: str) -> DataFrame:
    return R.fold_to_method(runs(spark, sf), "method", "seed", "fold", "value")


@query(f"WITH {ROLLED} SELECT method, n_seeds, n_fold_rows, round(mean_seed, 8) AS mean_seed, round(sd_seed, 8) AS sd_seed, round(worst_fold, 8) AS worst_fold, round(best_fold, 8) AS best_fold FROM t")
def fold_seed_method_summary(spark: SparkSession, sf: str) -> DataFrame:
    return r9(rolled(spark, sf).drop("sd_seed_pop"), "mean_seed", "sd_seed", "worst_fold", "best_fold", digits=8)


@query(f"WITH {ROLLED} SELECT method, round(sd_seed, 8) AS ddof1, round(sd_seed_pop, 8) AS ddof0 FROM t")
def summary_ddof0_ddof1(spark: SparkSession, sf: str) -> DataFrame:
    return r9(rolled(spark, sf).select("method", F.col("sd_seed").alias("ddof1"), F.col("sd_seed_pop").alias("ddof0")), "ddof1", "ddof0", digits=8)


@query(f"""WITH {RUNS}, f AS (SELECT method, fold, avg(value) AS value FROM v GROUP BY ALL)
SELECT method, round(avg(value), 8) AS mean_value, round(stddev_samp(value), 8) AS sd_value, round(median(value), 8) AS median_value, round(min(value), 8) AS min_value, round(max(value), 8) AS max_value,
arg_min(fold, value) AS worst_fold_id, arg_max(fold, value) AS best_fold_id FROM f GROUP BY method""")
def model_summary_wide(spark: SparkSession, sf: str) -> DataFrame:
    return r9(R.wide_summary(runs(spark, sf), "method", "fold", ["value"]), "mean_value", "sd_value", "median_value", "min_value", "max_value", digits=8).withColumns({c: F.col(c).cast("bigint") for c in ("worst_fold_id", "best_fold_id")})


@query(f"""WITH {ROLLED}, b AS (SELECT mean_seed AS bm, sd_seed AS bs FROM t WHERE method = 'click')
SELECT method, round(mean_seed - bm, 8) AS delta, round(2.0 * greatest(sd_seed, bs), 8) AS gate, CASE WHEN method = 'click' THEN '-' WHEN abs(mean_seed - bm) < 2.0 * greatest(sd_seed, bs) THEN 'within noise' WHEN mean_seed > bm THEN 'helps' ELSE 'hurts' END AS verdict FROM t, b""")
def delta_and_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return r9(R.against_baseline(rolled(spark, sf), "method", "click", "mean_seed", "sd_seed", 2.0).select("method", "delta", "gate", "verdict"), "delta", "gate", digits=8)


@query(f"""WITH {ROLLED} SELECT method, rank() OVER (ORDER BY mean_seed DESC) AS rank_mean, rank() OVER (ORDER BY sd_seed) AS rank_spread, rank() OVER (ORDER BY n_fold_rows DESC) AS rank_rows FROM t""")
def ranks_three_ways(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranks(rolled(spark, sf), {"mean": F.desc("mean_seed"), "spread": F.asc("sd_seed"), "rows": F.desc("n_fold_rows")}).select("method", *[F.col(f"rank_{n}").cast("bigint").alias(f"rank_{n}") for n in ("mean", "spread", "rows")])


@query("SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def keep_last_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return R.keep_last(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def keep_first_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return R.keep_first(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""WITH jobs AS (SELECT DISTINCT event_type, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 4 END AS rate, user_id % 5 AS seed FROM events), done AS (SELECT DISTINCT event_type, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 4 END AS rate, user_id % 5 AS seed FROM events WHERE value > 400)
SELECT * FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.event_type = j.event_type AND d.rate IS NOT DISTINCT FROM j.rate AND d.seed = j.seed)""")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    jobs = events.select("event_type", F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 4).alias("rate"), (F.col("user_id") % 5).alias("seed"), "value")
    return R.still_to_do(jobs.drop("value").distinct(), jobs.where("value > 400").drop("value").distinct(), ["event_type", "rate", "seed"])


@query(f"WITH {RUNS} SELECT fold, " + ", ".join(f"round(avg(value) FILTER (method = '{m}'), 8) AS {m}" for m in ("click", "purchase", "view")) + " FROM v GROUP BY fold")
def pivot_fraction_method(spark: SparkSession, sf: str) -> DataFrame:
    return r9(R.pivot(runs(spark, sf), ["fold"], "method", ["click", "purchase", "view"], F.avg("value")), "click", "purchase", "view", digits=8).withColumn("fold", F.col("fold").cast("bigint"))


@query(f"""WITH {RUNS}, s AS (SELECT method, seed, string_agg(printf('%.4f', m), ';' ORDER BY fold) AS folds FROM (SELECT method, seed, fold, round(avg(value), 6) AS m FROM v GROUP BY ALL) GROUP BY ALL),
e AS (SELECT method, seed, unnest(string_split(folds, ';'))::DOUBLE AS m FROM s) SELECT method, count(*) AS n, round(min(m), 4) AS least, round(max(m), 4) AS most FROM e GROUP BY method""")
def explode_score_list(spark: SparkSession, sf: str) -> DataFrame:
    folds = runs(spark, sf).groupBy("method", "seed", "fold").agg(F.round(F.avg("value"), 6).alias("m"))
    lists = folds.groupBy("method", "seed").agg(S.joined_scores(F.transform(F.array_sort(F.collect_list(F.struct("fold", "m"))), lambda s: s["m"])).alias("folds"))
    each = lists.select("method", F.explode(S.score_list(F.col("folds"))).alias("m"))
    return each.groupBy("method").agg(F.count("*").alias("n"), F.round(F.min("m"), 4).alias("least"), F.round(F.max("m"), 4).alias("most"))


@query(f"""WITH {ROLLED} SELECT method, round(coalesce((mean_seed - min(mean_seed) OVER ()) / nullif(max(mean_seed) OVER () - min(mean_seed) OVER (), 0), 0.5), 8) AS scaled_mean_seed,
round(1 - coalesce((sd_seed - min(sd_seed) OVER ()) / nullif(max(sd_seed) OVER () - min(sd_seed) OVER (), 0), 0.5), 8) AS scaled_sd_seed, round(coalesce((n_seeds - min(n_seeds) OVER ()) / nullif(max(n_seeds) OVER () - min(n_seeds) OVER (), 0), 0.5), 8) AS scaled_n_seeds FROM t""")
def minmax_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    out = R.scaled(rolled(spark, sf), {"mean_seed": False, "sd_seed": True, "n_seeds": False})
    return r9(out.select("method", "scaled_mean_seed", "scaled_sd_seed", "scaled_n_seeds"), "scaled_mean_seed", "scaled_sd_seed", "scaled_n_seeds", digits=8)


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value FROM events), b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
u AS (SELECT *, max(CASE WHEN before IS NULL OR value > before THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS top FROM b), s AS (SELECT user_id, min(epoch) AS stop FROM u WHERE epoch - top >= 3 GROUP BY user_id), k AS (SELECT u.* FROM u LEFT JOIN s USING (user_id) WHERE stop IS NULL OR epoch <= stop)
SELECT user_id, max(epoch) AS last_step, max(top) AS best_step, max(value) AS best FROM k GROUP BY user_id""")
def early_stopping(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    log = table(spark, sf, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("epoch"), "value")
    return R.early_stopping(log, "user_id", "epoch", "value", 3)


@query("""WITH m(model) AS (VALUES ('scratch'), ('masked'), ('contrast')), r(rate) AS (VALUES (0.0::DOUBLE), (0.001)), jobs AS (SELECT model, CAST(NULL AS DOUBLE) AS rate FROM m WHERE model = 'scratch' UNION ALL SELECT model, rate FROM m, r WHERE model <> 'scratch'),
g AS (SELECT model, rate, seed, fold FROM jobs, (SELECT DISTINCT user_id % 5 AS seed FROM events), (SELECT DISTINCT day(ts) % 5 AS fold FROM events))
SELECT *, row_number() OVER (ORDER BY model <> 'scratch', model, rate NULLS FIRST, seed, fold) AS job FROM g""")
def job_grid(spark: SparkSession, sf: str) -> DataFrame:
    models = spark.createDataFrame([("scratch",), ("masked",), ("contrast",)], "model string")
    rates = spark.createDataFrame([(0.0,), (0.001,)], "rate double")
    v = runs(spark, sf)
    out = R.job_grid(models, rates, v.select("seed").distinct(), v.select("fold").distinct())
    return out.withColumns({"job": F.col("job").cast("bigint"), "fold": F.col("fold").cast("bigint")})


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY ALL""")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint"))
    return events.groupBy("event_type", (F.col("p.k") % 10).alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"))


@query("""WITH f AS (SELECT event_type AS method, user_id % 5 AS seed, avg(value) AS loss FROM events GROUP BY ALL) SELECT method, seed, CASE WHEN seed = 0 THEN 'scratch' WHEN seed = 1 THEN 'frozen (LR 0)' ELSE 'enc LR 1e-0' || seed END AS setting, round(1 / (1 + exp(-loss / 100)), 9) AS p,
CASE WHEN loss / 100 - 0.5 > 0.003 THEN 'up' WHEN loss / 100 - 0.5 < -0.003 THEN 'down' ELSE 'flat' END AS sign FROM f""")
def labels_and_signs(spark: SparkSession, sf: str) -> DataFrame:
    f = runs(spark, sf).groupBy("method", "seed").agg(F.avg("value").alias("loss"))
    rate = F.when(F.col("seed") == 0, None).when(F.col("seed") == 1, 0.0).otherwise(F.pow(F.lit(10.0), -F.col("seed")))
    return f.select("method", "seed", S.encoder_rate_label(rate).alias("setting"), F.round(S.sigmoid(F.col("loss") / 100), 9).alias("p"), S.sign_label(F.col("loss") / 100 - 0.5).alias("sign"))
