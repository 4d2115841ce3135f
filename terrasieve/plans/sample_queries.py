"""Samples, splits, sets and checks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import pu as P
from ..operators import quality as Q
from ..operators import sampling as E
from ..registry import query, table


@query("""WITH e AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', vec_id::VARCHAR)), vec_id) AS rn FROM embeddings) SELECT vec_id, label FROM e WHERE rn <= 20""")
def exact_sample_per_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return E.sample_n(table(spark, sf, "embeddings").select("vec_id", "label"), ["label"], F.lit(20), 42, "vec_id")


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws('|', '7', o_orderkey::VARCHAR)), o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority FROM o WHERE rn <= greatest(2, round_even(n * 0.05, 0))""")
def proportional_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return E.proportional(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], 0.05, 7, "o_orderkey")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat_ws('|', '42', c_custkey::VARCHAR)), c_custkey) AS rn FROM customer) SELECT c_custkey, c_mktsegment, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM c""")
def stratified_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return E.k_folds(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], 5, 42, "c_custkey")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat_ws('|', '3', c_custkey::VARCHAR)), c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, c_mktsegment, CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'validation' ELSE 'train' END AS part FROM c""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return E.split(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], 0.2, 3, "c_custkey")


@query("""WITH d AS (SELECT d.doc_id, d.lang, l.toxic AS label, count(*) FILTER (l.toxic = 0) OVER (PARTITION BY d.lang) AS n0, count(*) FILTER (l.toxic = 1) OVER (PARTITION BY d.lang) AS n1, row_number() OVER (PARTITION BY d.lang, l.toxic ORDER BY md5(concat_ws('|', '42', d.doc_id::VARCHAR)), d.doc_id) AS rn FROM documents d JOIN labels l USING (doc_id))
SELECT doc_id, lang, label FROM d WHERE rn <= least(n0, n1)""")
def balanced_classes_per_cluster(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    return E.balanced(rows, "lang", "label", 42, "doc_id")


@query("""WITH o AS (SELECT o_custkey, o_orderkey % 5 AS fold FROM orders) SELECT o_custkey, count(DISTINCT fold) AS n_parts FROM o GROUP BY o_custkey HAVING count(DISTINCT fold) > 1""")
def group_leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    return Q.spread_groups(table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 5).alias("fold")), "o_custkey", "fold")


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag) AS n_parts FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1")
def label_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return rows.groupBy("l_partkey", "l_suppkey").agg(F.count_distinct("l_returnflag").alias("n_parts")).where("n_parts > 1")


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 1000 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 25 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def common_valid_ids(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    parts = [orders.where("o_totalprice > 1000").select(F.col("o_orderkey").alias("id")), lines.where("l_quantity > 25").select(F.col("l_orderkey").alias("id")), lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))]
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        every = p if every is None else every.unionByName(p)
    return E.common_ids(every, "id", "part", 3)


@query("SELECT k.label, count(e.vec_id) AS n FROM (SELECT unnest(range(12)) AS label) k LEFT JOIN embeddings e ON e.label = k.label GROUP BY k.label")
def zero_filled_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.filled_counts(table(spark, sf, "embeddings"), "label", 12)


@query("""WITH e AS (SELECT event_id, user_id, value, i AS iteration, row_number() OVER (PARTITION BY i ORDER BY md5(concat_ws('|', '42', i::VARCHAR, event_id::VARCHAR)), event_id) AS rn FROM events, (VALUES (0), (1), (2)) t(i)),
s AS (SELECT user_id AS candidate, least(value / 500.0, 1.0) AS p FROM e WHERE rn > 3000), t AS (SELECT candidate, count(p) AS times, count(*) FILTER (p < 0.1) AS votes, avg(p) AS mean_p, stddev_pop(p) AS sd_p FROM s GROUP BY candidate)
SELECT candidate, times, votes, round(votes / times, 9) AS ratio, round(mean_p, 7) AS mean_p, round(sd_p, 6) AS sd_p FROM t WHERE votes / times > 0.5""")
def pu_vote_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    drawn = E.bags(table(spark, sf, "events").select("event_id", "user_id", "value"), 3, 3000, 42, "event_id")
    scored = drawn.where("not in_bag").select(F.col("user_id").alias("candidate"), F.least(F.col("value") / 500.0, F.lit(1.0)).alias("p"))
    out = P.reliable_negatives(P.tally_votes(scored, "candidate", "p", 0.1), 0.5)
    return out.withColumns({"ratio": F.round("ratio", 9), "mean_p": F.round("mean_p", 7), "sd_p": F.round("sd_p", 6)})


@query("""WITH f AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, 1.0::DOUBLE AS c FROM embeddings), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f WHERE label < 5)
SELECT vec_id, round((a - ma) / sa, 7) AS a, round((b - mb) / sb, 7) AS b, 0.0::DOUBLE AS c FROM f, s WHERE label >= 5""")
def standardise_train_apply_test(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"), F.lit(1.0).alias("c"))
    out = P.standardised(rows.where("label < 5"), rows.where("label >= 5").drop("label"), ["a", "b", "c"])
    return out.withColumns({"a": F.round("a", 7), "b": F.round("b", 7), "c": F.round("c", 7)})


@query("""SELECT 'value in range' AS rule, count(*) FILTER (NOT (value BETWEEN 0 AND 300)) AS n FROM events UNION ALL SELECT 'known type', count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) FROM events UNION ALL SELECT 'id is there', count(*) FILTER (event_id IS NULL) FROM events
UNION ALL SELECT 'finite', count(*) FILTER (isnan(value) OR isinf(value)) FROM events""")
def quality_violations(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    rules = {"value in range": v.between(0, 300), "known type": F.col("event_type").isin("click", "view", "purchase"), "id is there": F.col("event_id").isNotNull(), "finite": S.is_valid(v)}
    return Q.violations(table(spark, sf, "events"), rules)


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_name END AS name, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) SELECT c_custkey, CASE WHEN coalesce(length(name), 0) = 0 THEN printf('L_%06d', k) ELSE name END AS sample_id FROM c""")
def synth_ids(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.running import running_totals

    name = F.when(F.col("c_custkey") % 3 == 2, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, "")
    rows = running_totals(table(spark, sf, "customer").select("c_custkey", name.alias("name")), [], "c_custkey", [], {"k": F.lit(1)})
    return rows.select("c_custkey", F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, F.format_string("L_%06d", "k")).otherwise(F.col("name")).alias("sample_id"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(CAST(value AS INTEGER) AS VARCHAR) END AS lon, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS lat FROM events)
SELECT event_id, TRY_CAST(lon AS DOUBLE) AS x, TRY_CAST(lat AS DOUBLE) AS y FROM r WHERE TRY_CAST(lon AS DOUBLE) IS NOT NULL AND TRY_CAST(lat AS DOUBLE) IS NOT NULL""")
def alias_and_coerce(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.points import numeric_points

    lon = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.rint("value").cast("int").cast("string"))
    lat = F.when(F.col("event_id") % 11 != 0, F.col("user_id").cast("string"))
    return numeric_points(table(spark, sf, "events").select("event_id", lon.alias("Longitude"), lat.alias("LATITUDE"))).select("event_id", "x", "y")


@query("SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment, n.n_name, r.r_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey WHERE o.o_orderstatus = 'F'")
def parents_attached(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "c_mktsegment", "n_name", "r_name")


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT user_id, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT user_id, 'one' FROM ((SELECT * FROM a UNION SELECT * FROM b) EXCEPT (SELECT * FROM a INTERSECT SELECT * FROM b))")
def shared_and_lost_ids(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "events").where("event_type in ('click', 'purchase')").groupBy("user_id").agg(F.count_distinct("event_type").alias("n"))
    return kinds.select("user_id", F.when(F.col("n") == 2, "both").otherwise("one").alias("side"))


@query("""WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS p, count(*) FILTER (o_orderstatus <> 'F') AS q FROM orders GROUP BY o_custkey),
r AS (SELECT o_custkey, row_number() OVER (ORDER BY p DESC, q DESC, md5(concat_ws('|', '42', o_custkey::VARCHAR)), o_custkey) - 1 AS i FROM g)
SELECT o_custkey, CASE WHEN i // 5 % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END::INTEGER AS fold FROM r""")
def group_safe_kfold(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_pos"), F.count_if(F.col("o_orderstatus") != "F").alias("n_neg"))
    return E.group_folds(groups, "o_custkey", 5)


@query()
def random_forest_pu(spark: SparkSession, sf: str) -> DataFrame:
    columns = [f"f{i}" for i in range(64)]
    rows = table(spark, sf, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])
    positives = rows.where("label = 0")
    scored = P.bagged_scores(positives, rows.where("label <> 0"), columns, "vec_id", 50, positives.count())
    return P.reliable_negatives(P.tally_votes(scored, "vec_id", "p", 0.5), 0.5)
