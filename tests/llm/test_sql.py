"""Queries with SQL give the rows of it in DuckDB, also beside nulls, ties and odd texts."""

import glob
import os

import duckdb
import pytest
from terrasieve.llm import queries as Q


def compare(spark, folder, name):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    df = Q.QUERIES[name](spark, folder)
    columns = df.columns
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({Q.SQL[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_its_sql(spark, sf, name):
    compare(spark, sf, name)


@pytest.mark.parametrize("name", ["op11_jaccard_join", "op12_importance_resampling"])
def test_odd_rows(spark, tmp_path, name):
    text = "the quick brown fox jumps over the lazy dog and runs far away from all of the other animals in Ünïcode 日本"
    docs = [(1, text), (2, text.upper().replace("Ü", "ü")), (3, None), (4, ""), (None, text), (2**53 + 1, text + " end"), (6, "a b"), (7, "A  B"), (8, "x" * 300 + " y" * 40), (1, text + " more words"), (9, "...")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "brown fox and x x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    compare(spark, str(tmp_path), name)
