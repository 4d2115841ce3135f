"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import placements

    return placements(read(spark, sf_dir, "documents")).drop("__row")


@query
def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import compare

    return compare(read(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import report

    return report(read(spark, sf_dir, "documents"), beside=True)


@query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(read(spark, sf_dir, "documents"))


@query
def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, fold, score

    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    # Rows with a null id are not held out, nor learned from.
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(read(spark, sf_dir, "documents"))


@query
def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(read(spark, sf_dir, "pages"))


@query
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import components

    return components(read(spark, sf_dir, "documents"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(read(spark, sf_dir, "embeddings"))


SQL["op10_warc_round_trip"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, html, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM s
"""

# Sets as lists, links by counting shared shingles, components by following links.
SQL["op11_jaccard_join"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t
), k AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, len(g) AS n, g FROM s),
e AS MATERIALIZED (SELECT r, n, unnest(g) AS x FROM k),
p AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT r, r FROM k UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b)
SELECT k.doc_id, k.n AS n_shingles, min(o.doc_id) AS component_id FROM k JOIN reach ON reach.a = k.r JOIN k o ON o.r = reach.b GROUP BY k.r, k.doc_id, k.n
"""
# CRC-32 byte by byte, from a table of 256 made by its rule.
SQL["op12_importance_resampling"] = r"""
WITH table256 AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::UBIGINT] || list_transform(range(8), lambda j: 0::UBIGINT), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), both_texts AS (SELECT true AS own, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT false, item_id, coalesce(text, '') FROM benchmark),
words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, own, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM both_texts
), f AS MATERIALIZED (
  SELECT r, own, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM words
), bytes AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM f)),
b AS MATERIALIZED (
  SELECT x, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT), lambda c, y: xor(c >> 8, t[((xor(c, y) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM bytes, table256
), n AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f JOIN b USING (x) GROUP BY bucket),
total AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM n),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE)) AS g FROM n, total),
w AS (SELECT r, count(*) AS n_features, floor(sum(g) / count(*))::BIGINT AS weight FROM f JOIN b USING (x) JOIN gain USING (bucket) WHERE own GROUP BY r),
scored AS (
  SELECT words.r, id AS doc_id, len(words.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN w USING (r) WHERE own
), ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * n // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (r)
"""


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
