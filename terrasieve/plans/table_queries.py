"""Counts, gaps, orders, draws and checks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bank as B
from ..operators import candidates as N
from ..operators import cluster as C
from ..operators import quality as Q
from ..operators import report as K
from ..operators import sampling as E
from ..operators import tables as A
from ..registry import query, table
from .metric_queries import r9
from .raster_queries import drawn
from .spatial_queries import ASSIGNED, POINTS, centres, points

LABELLED = "d AS (SELECT doc_id, lang, source, n_chars, toxic, quality FROM documents JOIN labels USING (doc_id))"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id")


# ---- counts and reports ----------------------------------------------------------------------


@query(f"WITH {LABELLED} SELECT lang, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM d GROUP BY lang")
def cluster_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return A.crosstab(labelled(spark, sf), "lang", "toxic", [0, 1])


@query(f"""WITH {LABELLED}, g AS (SELECT lang, count(*) FILTER (toxic = 1) AS n_pos, count(*) FILTER (toxic = 0) AS n_neg, count(*) FILTER (toxic = 0 AND n_chars > 2000) AS n_chosen FROM d GROUP BY lang)
SELECT *, CASE WHEN n_chosen = 0 THEN 'infinity'::DOUBLE ELSE n_pos / n_chosen END AS ratio FROM g""")
def balance_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled(spark, sf).withColumn("chosen", F.col("n_chars") > 2000)
    return C.balance_summary(rows, "lang", "toxic", "chosen")


@query("""WITH f AS (SELECT o_custkey % 5 AS fold, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_pos, count(*) FILTER (o_orderstatus <> 'F') AS n_neg FROM orders GROUP BY fold)
SELECT *, n_pos >= 30 AND n_neg >= 30 AS usable FROM f""")
def fold_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("fold"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return A.fold_table(rows, "fold", "y", 30)


@query("""SELECT p_type AS value, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN NULL ELSE p_type END AS p_type FROM part)
WHERE p_type <> '' GROUP BY p_type ORDER BY n DESC, value LIMIT 8""")
def frequent_values(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    return A.frequent_values(table(spark, sf, "part").select(F.when(k == 0, "").when(k > 1, F.col("p_type")).alias("t")), "t", 8)


GAP = """(SELECT avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b, var_samp(value) FILTER (event_type = 'click') AS va, var_samp(value) FILTER (event_type = 'view') AS vb FROM events)"""


@query(f"""SELECT round(a, 7) AS mean_a, round(b, 7) AS mean_b, round(a - b, 7) AS gap, round(sqrt((va + vb) / 2), 6) AS pooled_sd, round((a - b) / sqrt((va + vb) / 2), 7) AS effect,
  abs(a - b) > sqrt(greatest(va, vb)) AS over_spread, abs(a - b) > 2 * sqrt(greatest(va, vb)) AS over_noise FROM {GAP}""")
def arm_gap(spark: SparkSession, sf: str) -> DataFrame:
    out = A.arm_gap(table(spark, sf, "events"), "event_type", "click", "view", "value")
    return r9(r9(out, "mean_a", "mean_b", "gap", "effect", digits=7), "pooled_sd", digits=6)


@query("""WITH s AS (SELECT event_type AS arm, user_id % 5 AS seed, avg(value) AS m FROM events GROUP BY ALL)
SELECT arm, count(*) AS n_seeds, round(avg(m), 7) AS mean, round(stddev_samp(m), 6) AS sd, string_agg(printf('%d:%.10f', seed, m), ';' ORDER BY seed) AS per_seed FROM s GROUP BY arm""")
def per_seed_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("seed"), "value")
    return r9(r9(A.seed_text(rows, "arm", "seed", "value", 10), "mean", digits=7), "sd", digits=6)


@query("""WITH m AS (SELECT event_type AS method, avg(value) AS v FROM events GROUP BY ALL), r(reference, x) AS (VALUES ('mean', 99.5::DOUBLE), ('best', 120.25), ('worst', 80.0))
SELECT method, reference, round(v - x, 7) AS delta FROM m, r""")
def reference_deltas(spark: SparkSession, sf: str) -> DataFrame:
    summary = table(spark, sf, "events").groupBy(F.col("event_type").alias("method")).agg(F.avg("value").alias("v"))
    return r9(A.against_references(summary, "method", "v", {"mean": 99.5, "best": 120.25, "worst": 80.0}), "delta", digits=7)


@query("""WITH l AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE value)
SELECT l_returnflag, metric, round(avg(value), 7) AS mean, round(stddev_samp(value), 6) AS sd FROM l GROUP BY ALL""")
def long_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    return r9(r9(A.long_metrics(rows, ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"]), "mean", digits=7), "sd", digits=6)


ROLES = {"click": "baseline", "view": "spatial", "purchase": "spectral"}


@query("""WITH m AS (SELECT event_type AS name, count(*) AS n FROM events GROUP BY ALL), k(name, role) AS (VALUES ('click', 'baseline'), ('view', 'spatial'), ('purchase', 'spectral'))
SELECT name, n, coalesce(role, 'unknown') AS role FROM m LEFT JOIN k USING (name)""")
def mapped_roles(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return counts.withColumn("role", A.mapped(F.col("name"), ROLES, "unknown"))


@query("""WITH k(name, finding) AS (VALUES ('click', 'helps'), ('view', 'hurts'), ('hover', 'none')), m AS (SELECT event_type AS name, round(avg(value), 7) AS mean FROM events GROUP BY ALL)
SELECT name, finding, mean FROM k LEFT JOIN m USING (name)""")
def described_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 7).alias("mean"))
    known = spark.createDataFrame([("click", "helps"), ("view", "hurts"), ("hover", "none")], "name string, finding string")
    return known.join(summary, "name", "left")


@query("""WITH m AS (SELECT event_type AS name, count(*) AS n FROM events GROUP BY ALL)
SELECT name, n, row_number() OVER (ORDER BY CASE name WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, name)::INTEGER AS position FROM m""")
def custom_order(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return A.in_order(counts, "name", ["purchase", "click"])


@query("SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS position FROM orders")
def sorted_positions(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.running import running_totals

    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return running_totals(rows, [], "o_custkey", ["o_orderkey"], {"position": F.lit(1)})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def greatest_first(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 40")
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id").orderBy("event_id").limit(40)


@query("SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k <= 10")
def first_n_of_group(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.running import running_totals

    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = running_totals(rows, ["l_returnflag"], "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], {"k": F.lit(1)}, wanted=F.col("__before_k") < 10)
    return out.where("k <= 10").select("l_returnflag", "l_orderkey", "l_linenumber")


@query(f"WITH {ASSIGNED} SELECT k, id, round(d2, 9) AS d2 FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY d2 DESC, id) = 1")
def farthest_points(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.geo import nearest_centre

    return r9(A.farthest(nearest_centre(points(spark, sf), centres(spark)), ["k"], "id", "d2"), "d2")


@query("SELECT user_id % 7 AS run, round(sum(value * (event_id % 9 + 1)) / sum(event_id % 9 + 1), 7) AS loss FROM events GROUP BY run")
def weighted_loss(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select((F.col("user_id") % 7).alias("run"), "value", (F.col("event_id") % 9 + 1).alias("n"))
    return r9(A.weighted_loss(log, ["run"], "value", "n"), "loss", digits=7)


@query("""WITH g AS (SELECT vec_id, label % 4 AS target, c, embedding[c + 1] AS logit FROM embeddings, (SELECT unnest(range(4)) AS c)),
b AS (SELECT vec_id, any_value(target) AS t, first(c ORDER BY logit DESC, c) AS c FROM g GROUP BY vec_id) SELECT avg((c = t)::INTEGER)::DOUBLE AS accuracy, count(*) AS n FROM b""")
def rotation_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    logits = e.select("vec_id", (F.col("label") % 4).alias("target"), F.posexplode(F.slice("embedding", 1, 4)).alias("c", "logit"))
    return A.top_class_accuracy(logits, "vec_id", "c", "target", "logit")


@query("""SELECT user_id, count(DISTINCT event_type) AS n_classes, round(ln(count(DISTINCT event_type)), 12) AS guess_loss, round(1.0::DOUBLE / count(DISTINCT event_type), 12) AS guess_accuracy FROM events GROUP BY user_id""")
def guess_lines(spark: SparkSession, sf: str) -> DataFrame:
    return r9(K.guess_lines(table(spark, sf, "events"), ["user_id"], "event_type"), "guess_loss", "guess_accuracy", digits=12)


# ---- labels, tags and filters ----------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'lr' ELSE 'lr_' || replace(replace(printf('%g', [1e-3, 3e-4, 1e-5, 0.5, 2e7][(event_id % 5 + 1)::INTEGER]::DOUBLE), '+', ''), '.', 'p') END AS tag,
CASE WHEN event_type = 'click' THEN 'FEAT_' || user_id ELSE event_id::VARCHAR END AS grp FROM events""")
def rate_tags(spark: SparkSession, sf: str) -> DataFrame:
    rate = F.get(F.array(*[F.lit(x) for x in (1e-3, 3e-4, 1e-5, 0.5, 2e7)]), (F.col("event_id") % 5).cast("int"))
    tag = F.when(F.col("user_id") % 5 == 0, "lr").otherwise(F.concat(F.lit("lr_"), S.rate_tag(rate)))
    group = F.when(F.col("event_type") == "click", F.concat(F.lit("FEAT_"), "user_id")).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", tag.alias("tag"), group.alias("grp"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value * 1e-6 END AS rate FROM events) SELECT event_id FROM e WHERE abs(coalesce(rate, -1) - 1e-4) <= 1e-8 + 1e-1 * 1e-4 OR rate IS NULL AND event_id % 8 = 0""")
def near_rates(spark: SparkSession, sf: str) -> DataFrame:
    rate = F.when(F.col("event_id") % 4 != 0, F.col("value") * 1e-6)
    near = S.is_close(F.coalesce(rate, F.lit(-1.0)), F.lit(1e-4), 1e-1, 1e-8)
    return table(spark, sf, "events").where(near | (rate.isNull() & (F.col("event_id") % 8 == 0))).select("event_id")


@query("""WITH m AS (SELECT user_id AS method, avg(value) - 100 AS gain, stddev_samp(value) AS sd FROM events GROUP BY ALL)
SELECT method, CASE WHEN gain > 0 AND gain > sd / 4 THEN 'Effective' ELSE 'Weak transfer' END AS outcome, CASE WHEN method % 3 = 0 THEN -gain ELSE round(sd, 6) END > 0 AS watched FROM m""")
def outcome_labels(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "events").groupBy(F.col("user_id").alias("method")).agg((F.avg("value") - 100).alias("gain"), F.stddev_samp("value").alias("sd"))
    auc = F.when(F.col("method") % 3 == 0, F.lit(float("nan"))).otherwise(F.round("sd", 6))
    return m.select("method", S.outcome(F.col("gain"), F.col("sd") / 4).alias("outcome"), (S.monitor_value(auc, F.col("gain")) > 0).alias("watched"))


@query("SELECT p_partkey, p_size FROM part WHERE p_retailprice / 2000 <= 0.5 AND p_size % 2 = 1")
def low_mean_selection(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.pu import low_scored

    rows = table(spark, sf, "part").withColumns({"mean_p": F.col("p_retailprice") / 2000, "centre": F.col("p_size") % 2 == 1})
    return low_scored(rows, 0.5).where("centre").select("p_partkey", "p_size")


@query("""SELECT c_custkey AS sample_id, 1 AS label, 'inventory' AS source FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT s_suppkey, 0, 'reliable' FROM supplier""")
def labelled_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("sample_id"), F.lit(1).alias("label"), F.lit("inventory").alias("source"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.lit(0).alias("label"), F.lit("reliable").alias("source"))
    return a.unionByName(b)


PARTS = "s AS (SELECT o_custkey AS id, o_orderkey % 3 AS part FROM orders)"


@query(f"WITH {PARTS}, u AS (SELECT DISTINCT id, part FROM s) SELECT a.part AS a, b.part AS b, count(*) AS shared FROM u a JOIN u b ON a.id = b.id AND a.part < b.part GROUP BY ALL")
def shared_between_parts(spark: SparkSession, sf: str) -> DataFrame:
    return A.disjoint_parts(table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 3).alias("part")), "id", "part")


@query(f"WITH {PARTS} SELECT id, count(DISTINCT part) AS n FROM s GROUP BY id HAVING count(DISTINCT part) < 3")
def ids_not_in_all(spark: SparkSession, sf: str) -> DataFrame:
    return A.unequal_sets(table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 3).alias("part")), "id", "part", 3)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def rows_of_common_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""WITH v AS (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F') AS votes, count(*) AS times FROM orders GROUP BY ALL)
SELECT c_custkey AS id, c_mktsegment, coalesce(votes, 0) AS votes, coalesce(times, 0) AS times FROM customer LEFT JOIN v ON c_custkey = id""")
def votes_attached(spark: SparkSession, sf: str) -> DataFrame:
    votes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("votes"), F.count("*").alias("times"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment").join(votes, "id", "left").na.fill({"votes": 0, "times": 0})


@query("SELECT l.doc_id, d.lang, d.source, l.quality AS y_true, least(d.n_chars / 20000.0, 1.0)::DOUBLE AS y_prob FROM labels l JOIN documents d USING (doc_id)")
def predictions_with_places(spark: SparkSession, sf: str) -> DataFrame:
    d = labelled(spark, sf)
    return d.select("doc_id", "lang", "source", F.col("quality").alias("y_true"), F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("y_prob"))


# ---- draws -----------------------------------------------------------------------------------


@query("""WITH s AS (SELECT c_custkey, c_custkey % 5 AS fold FROM customer), j AS (SELECT f AS held_fold, seed, fraction FROM (SELECT DISTINCT fold AS f FROM s), (VALUES (1), (2)) a(seed), (VALUES (0.1::DOUBLE), (0.25)) b(fraction)),
e AS (SELECT s.*, j.*, count(*) OVER (PARTITION BY held_fold, seed, fraction) AS n, row_number() OVER (PARTITION BY held_fold, seed, fraction ORDER BY md5(concat_ws('|', 'pair', seed::VARCHAR, held_fold::VARCHAR, fraction::VARCHAR, c_custkey::VARCHAR)), c_custkey) AS rn FROM s JOIN j ON fold <> held_fold)
SELECT seed, held_fold, fraction, c_custkey FROM e WHERE rn <= greatest(8, round_even(n * fraction, 0))""")
def paired_subsample(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("fold"))
    return N.paired_draw(rows, "fold", [0.1, 0.25], [1, 2], "c_custkey").select("seed", "held_fold", "fraction", "c_custkey")


@query(f"""WITH {LABELLED}, e AS (SELECT doc_id, toxic, count(*) OVER (PARTITION BY toxic) AS n, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat_ws('|', '11', doc_id::VARCHAR)), doc_id) AS rn FROM d)
SELECT doc_id, toxic FROM e WHERE rn <= least(n, greatest(2, round_even(n * 0.25, 0)))""")
def class_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return E.proportional(labelled(spark, sf).select("doc_id", "toxic"), ["toxic"], 0.25, 11, "doc_id")


@query(f"WITH {LABELLED}, e AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat_ws('|', 'smoke', doc_id::VARCHAR)), doc_id) AS rn FROM d) SELECT doc_id, toxic FROM e WHERE rn <= 10")
def smoke_subset(spark: SparkSession, sf: str) -> DataFrame:
    return E.sample_n(labelled(spark, sf).select("doc_id", "toxic"), ["toxic"], F.lit(20 // 2), "smoke", "doc_id")


@query("""WITH e AS (SELECT event_id, count(*) OVER () AS n, row_number() OVER (ORDER BY md5(concat_ws('|', '13', event_id::VARCHAR)), event_id) AS rn FROM events)
SELECT event_id, CASE WHEN rn <= floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'train' END AS part, CASE WHEN rn <= round_even(n * 0.1::DOUBLE, 0) THEN 'validation' ELSE 'train' END AS rounded FROM e""")
def random_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id")
    down = E.split(rows, [], 0.1, 13, "event_id", F.floor)
    return down.join(E.split(rows, [], 0.1, 13, "event_id").withColumnRenamed("part", "rounded"), "event_id")


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, k, (n // 7 + CASE WHEN k < n % 7 THEN 1 ELSE 0 END)::BIGINT AS capacity FROM n, (SELECT unnest(range(7)) AS k)")
def balanced_capacities(spark: SparkSession, sf: str) -> DataFrame:
    return E.capacities_by(table(spark, sf, "embeddings"), "label", 7)


@query(f"WITH {POINTS} SELECT id, floor(({drawn("'3'", "id", "'task'")}) * 4)::INTEGER AS task FROM p")
def task_labels(spark: SparkSession, sf: str) -> DataFrame:
    return N.task_labels(points(spark, sf).select("id"), "id", 4, 3)


@query("""WITH u AS (SELECT vec_id, label FROM embeddings WHERE label <> 0), m AS (SELECT count(*) AS m FROM embeddings WHERE label = 0),
e AS (SELECT vec_id, i, row_number() OVER (PARTITION BY i ORDER BY md5(concat_ws('|', '42', i::VARCHAR, vec_id::VARCHAR)), vec_id) AS rn FROM u, (SELECT unnest(range(50)) AS i))
SELECT vec_id, count(*) FILTER (rn > m) AS times, count(*) FILTER (rn <= m) AS drawn FROM e, m GROUP BY vec_id""")
def forest_bag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each candidate of ``random_forest_pu`` is drawn, and scored."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    out = E.bags(rows.where("label <> 0"), 50, rows.where("label = 0").count(), 42, "vec_id")
    return out.groupBy("vec_id").agg(F.count_if(~F.col("in_bag")).alias("times"), F.count_if("in_bag").alias("drawn"))


# ---- banks -----------------------------------------------------------------------------------


@query(f"""WITH {POINTS}, d AS (SELECT id, floor(({drawn("'6'", "id", "'bank'")}) * 6)::INTEGER AS perm_id FROM p)
SELECT id, perm_id, a AS first, b AS second, c AS third FROM d JOIN (VALUES (0, 0, 1, 2), (1, 0, 2, 1), (2, 1, 0, 2), (3, 1, 2, 0), (4, 2, 0, 1), (5, 2, 1, 0)) t(perm_id, a, b, c) USING (perm_id)""")
def strip_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Each patch with the order of strips that is drawn for it."""
    out = B.shuffled_by_bank(points(spark, sf).select("id"), "id", B.all_permutations(spark, 3), 6)
    return out.select("id", "perm_id", *[F.get("perm", F.lit(i)).alias(n) for i, n in enumerate(("first", "second", "third"))])


@query(f"""WITH {POINTS}, u AS (SELECT id, i, ({drawn("'8'", "id", "i")}) AS u FROM p, (SELECT unnest(range(6)) AS i)), q AS (SELECT id, string_agg(i::VARCHAR, ',' ORDER BY u, i) AS perm FROM u GROUP BY id)
SELECT min(id) AS id, perm FROM q GROUP BY perm""")
def permutation_pool(spark: SparkSession, sf: str) -> DataFrame:
    return B.drawn_for(points(spark, sf).select("id"), 6, 8).select("id", F.array_join("perm", ",").alias("perm"))


@query("""WITH e AS (SELECT vec_id, unnest(range(5)) AS i, unnest(embedding[1:5]) AS v FROM embeddings),
b AS (SELECT vec_id // 2 AS perm_id, string_agg((CASE WHEN vec_id % 50 = 0 AND i = 4 THEN 5 ELSE i END)::VARCHAR, ',' ORDER BY v, i) AS perm, vec_id % 50 = 0 AS odd FROM e GROUP BY vec_id),
n AS (SELECT count(*) AS n, count(DISTINCT perm) AS perms, count(DISTINCT perm_id) AS ids, max(perm_id) AS last, count(*) FILTER (odd) AS odd FROM b)
SELECT 'no permutation' AS rule, odd AS n FROM n UNION ALL SELECT 'repeated', n - perms FROM n UNION ALL SELECT 'class ids', n - ids FROM n
UNION ALL SELECT 'number of rows', abs(n - 300) FROM n UNION ALL SELECT 'gaps in class ids', last + 1 - n FROM n""")
def bank_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A bank of the orders of five numbers, some of them no permutations, with ids in pairs."""
    e = table(spark, sf, "embeddings")
    order = F.array_sort(F.transform(F.slice("embedding", 1, 5), lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    part = lambda x: F.when((F.col("vec_id") % 50 == 0) & (x["i"] == 4), 5).otherwise(x["i"])
    bank = e.select(F.floor(F.col("vec_id") / 2).alias("perm_id"), F.transform(order, part).alias("perm"))
    return B.broken(bank, 5, 300)


# ---- checks ----------------------------------------------------------------------------------


@query(f"""WITH {LABELLED}, r AS (SELECT doc_id AS id, n_chars % 6 AS k, toxic + CASE WHEN doc_id % 50 = 0 THEN 2 ELSE 0 END AS y FROM d), c AS (SELECT k, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM r GROUP BY k)
SELECT 'label is 0 or 1' AS rule, count(*) FILTER (y NOT IN (0, 1)) AS n FROM r UNION ALL SELECT 'cluster in domain', count(*) FILTER (k NOT BETWEEN 0 AND 4) FROM r UNION ALL SELECT 'id is there', count(*) FILTER (id IS NULL) FROM r
UNION ALL SELECT 'id is unique', count(*) FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'both classes in a cluster', count(*) FILTER (p = 0 OR q = 0) FROM c
UNION ALL SELECT 'counts of a cluster are close', count(*) FILTER (abs(p - q) > 1) FROM c UNION ALL SELECT 'every cluster is there', 5 - count(*) FROM c""")
def final_set_rules(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("toxic") + F.when(F.col("doc_id") % 50 == 0, 2).otherwise(0)
    return Q.final_set_rules(labelled(spark, sf).select(F.col("doc_id").alias("id"), (F.col("n_chars") % 6).alias("k"), y.alias("y")), "k", "y", "id", 5)


@query("""WITH r AS (SELECT o_custkey AS id, o_orderkey % 2 AS part, o_totalprice > 1000 AS ok, o_orderstatus AS label FROM orders), b AS (SELECT id, count(DISTINCT part) AS p, count(*) AS n, count(DISTINCT label) AS l FROM r GROUP BY id)
SELECT 'id is in every part' AS rule, count(*) FILTER (p < 2) AS n FROM b UNION ALL SELECT 'id is once in a part', count(*) FILTER (n > p) FROM b UNION ALL SELECT 'id has one label', count(*) FILTER (l > 1) FROM b UNION ALL SELECT 'row is valid', count(*) FILTER (NOT ok) FROM r""")
def common_set_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 2).alias("part"), (F.col("o_totalprice") > 1000).alias("ok"), F.col("o_orderstatus").alias("label"))
    return Q.common_set_rules(rows, "id", "part", 2, "ok", "label")


@query("""WITH r AS (SELECT event_type AS model, user_id % 6 AS fold, user_id AS id, value / 250 AS p, event_id % 3 AS y FROM events)
SELECT model, 'fold in domain' AS rule, count(*) FILTER (fold NOT BETWEEN 0 AND 4) AS n FROM r GROUP BY model UNION ALL SELECT model, 'probability in range', count(*) FILTER (p NOT BETWEEN 0 AND 1) FROM r GROUP BY model
UNION ALL SELECT model, 'label is 0 or 1', count(*) FILTER (y NOT IN (0, 1)) FROM r GROUP BY model
UNION ALL SELECT model, 'id is once in a fold', count(*) FILTER (k > 1) FROM (SELECT model, fold, id, count(*) AS k FROM r GROUP BY ALL) GROUP BY model""")
def prediction_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 6).alias("fold"), F.col("user_id").alias("id"), (F.col("value") / 250).alias("p"), (F.col("event_id") % 3).alias("y"))
    return Q.prediction_rules(rows, "model", "fold", "id", "p", "y", 5)


@query("""WITH t AS (SELECT user_id % 4 AS band, avg(value) AS mean, stddev_pop(value) AS sd FROM events GROUP BY ALL), s AS (SELECT band, mean, CASE WHEN band = 3 THEN 0.0 ELSE sd END AS sd FROM t)
SELECT 'mean is finite' AS rule, count(*) FILTER (isnan(mean) OR isinf(mean)) AS n FROM s UNION ALL SELECT 'sd is finite', count(*) FILTER (isnan(sd) OR isinf(sd)) FROM s UNION ALL SELECT 'sd is positive', count(*) FILTER (NOT sd > 0) FROM s""")
def statistics_rules(spark: SparkSession, sf: str) -> DataFrame:
    stats = table(spark, sf, "events").groupBy((F.col("user_id") % 4).alias("band")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return Q.statistics_rules(stats.withColumn("sd", F.when(F.col("band") == 3, 0.0).otherwise(F.col("sd"))))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 <> 0 THEN 'FEAT_' || o_custkey::VARCHAR ELSE o_orderkey::VARCHAR END AS cv_group FROM orders""")
def group_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Positives of one mapped feature share a key, all else stands alone."""
    o = table(spark, sf, "orders")
    label, feature = (F.col("o_orderstatus") == "F").cast("int"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey"))
    return o.select("o_orderkey", S.group_key(label, feature, F.col("o_orderkey")).alias("cv_group"))


@query("""WITH l AS (SELECT event_id % 50 - 1 AS epoch, value - 5 AS train_loss, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS val_loss FROM events)
SELECT 'epoch is not negative' AS rule, count(*) FILTER (epoch < 0) AS n FROM l UNION ALL SELECT 'train_loss is finite', count(*) FILTER (train_loss IS NULL) FROM l
UNION ALL SELECT 'train_loss is not negative', count(*) FILTER (train_loss < 0) FROM l UNION ALL SELECT 'val_loss is finite', count(*) FILTER (val_loss IS NULL) FROM l
UNION ALL SELECT 'val_loss is not negative', count(*) FILTER (val_loss IS NULL OR val_loss < 0) FROM l""")
def training_log_rules(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    logs = e.select((F.col("event_id") % 50 - 1).alias("epoch"), (F.col("value") - 5).alias("train_loss"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("val_loss"))
    return Q.log_rules(logs, ["epoch", "train_loss", "val_loss"], ["train_loss", "val_loss"])
