import math

import numpy as np
import pytest
from terrasieve.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component double"


def fixture(n=300, d=24):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(d, d)) * np.linspace(3, 0.2, d)
    v = (rng.normal(size=(n, d)) @ mix + rng.normal(size=d) * 40).astype(np.float32)
    rows = [(i, v[i].tolist(), 1, "x", 0.5) for i in range(n)]
    rows += [(1000 + i, v[3].tolist(), 1, "x", 0.5) for i in range(60)] + [rows[4]] * 2
    odd = [(2**53 + 1, v[7].tolist()), (None, v[8].tolist()), (2001, None), (2002, []), (2003, [None, *v[0].tolist()[1:]]), (2004, [math.nan, *v[0].tolist()[1:]]), (2005, [math.inf, *v[0].tolist()[1:]]), (2006, [1.0, 2.0])]
    return rows + [(i, x, None, None, None) for i, x in odd]


def brute(rows):
    keep = [(r[0], [math.floor(64 * float(c)) + 1_000_000 for c in r[1]]) for r in rows if r[1] and None not in r[1] and all(map(math.isfinite, r[1])) and len(r[1]) > 2]
    fit = sorted({tuple(x) for _, x in keep})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in keep]
    f = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(f.T @ f / n)
    return keep, n, sums, deviation, values[::-1], vectors[:, ::-1]


def test_against_plain_arithmetic(spark):
    rows = fixture()
    keep, n, sums, deviation, values, vectors = brute(rows)
    got = W.whitened(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == 16 * len(keep) and {r.n for r in got} == {n}
    from collections import Counter

    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 16) == Counter((i, d) for (i, _), d in zip(keep, deviation, strict=True))
    of = {}
    for (i, x), _ in zip(keep, deviation, strict=True):
        of[i] = (np.array(x) - np.array(sums) / n) @ vectors / np.sqrt(values)
    sign = {c: np.sign(next(r.whitened for r in got if r.vec_id == 0 and r.component == c) * of[0][c - 1]) for c in range(1, 17)}
    for r in got:
        assert r.whitened == pytest.approx(sign[r.component] * of[r.vec_id][r.component - 1], abs=1e-8)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_several_aggregations_give_the_same_matrix(spark, monkeypatch):
    df = spark.createDataFrame([([float(i * j % 7) for j in range(6)],) for i in range(50)], "c array<double>")
    one = W.pair_sums(df, "c", 6)
    monkeypatch.setattr(W, "MOST_SUMS", 4)
    assert (W.pair_sums(df, "c", 6) == one).all() and (one == one.T).all()


def test_fewer_dimensions_and_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)
    got = W.whitened(df).collect()  # one direction only has variance
    assert {r.component for r in got} == {1} and len(got) == 9
    assert got[0].explained == pytest.approx(1.0) and got[0].identity_error < 1e-9
    assert W.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    empty = W.whitened(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == [c.split()[0] for c in W.SCHEMA.split(", ")]
    assert W.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0


def test_wide_range_of_values(spark):
    schema = "vec_id long, embedding array<float>"
    got = W.whitened(spark.createDataFrame([(1, [1e38, 0.0]), (2, [-1e38, 1.0]), (3, [0.0, 7.0])], schema)).collect()
    # The second dimension is rounding beside the first one; 3 stands on the mean of the first.
    assert {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: sum((3 * a - s) ** 2 for a, s in ((1000448, 3000512),))}
    assert len(got) == 3 and all(math.isfinite(r.whitened) for r in got)


def test_query(spark, sf):
    from terrasieve.llm.queries import op13_whitening

    df = op13_whitening(spark, sf)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = [(r.vec_id, r.embedding, 0, "", 0.0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    keep, n, _, deviation, values, _ = brute(rows)
    got = df.collect()
    assert sorted((r.vec_id, r.deviation, r.n) for r in got if r.component == 1) == sorted((i, d, n) for (i, _), d in zip(keep, deviation, strict=True))
    assert [r.explained for r in sorted(got, key=lambda r: (r.vec_id, r.component))[:16]] == pytest.approx((values / values.sum())[:16].tolist(), rel=1e-9)
