"""Every query that SQL can express gives the rows of its SQL in DuckDB; the few without SQL have
tests of their own (named below)."""

import glob
import math
import os

import duckdb
import pytest
from terrasieve.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


#: Queries without SQL, and where they are tested.
ELSEWHERE = {"random_forest_pu": "test_pu.py", "kmeans_search": "test_cluster.py", "capacity_assignment": "test_cluster.py"}


def test_queries_without_sql_are_named():
    assert set(QUERIES) - set(SQL) == set(ELSEWHERE)


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    return str(float(value)) if type(value).__name__ == "Decimal" else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    found = duck.execute(SQL[name])
    own = [d[0] for d in found.description]
    assert sorted(own) == columns
    want = [tuple(r[own.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in want)
