import pytest
from pyspark.sql import functions as F
from terrasieve.operators import candidates as N

BOX = (0.0, 0.0, 1.0, 1.0)


def scarce(draws):
    return draws.where("x < 0.05").withColumn("extra", F.lit(1))


def test_a_scarce_area_takes_several_batches(spark):
    seen = []

    def accept(draws):
        seen.append(draws.count())
        return scarce(draws)

    got = N.accepted_points(spark, BOX, accept, 20, 50, 5000, 3)
    assert seen == [50 * 2**i for i in range(len(seen))] and len(seen) > 2
    want = [r.id for r in scarce(N.random_points(spark, 5000, 3, *BOX)).orderBy("id").limit(20).collect()]
    rows = got.orderBy("rn").collect()
    assert [r.id for r in rows] == want and [r.rn for r in rows] == list(range(1, 21)) and rows[4].candidate_id == "U_000005"
    # However draws are cut, the same places are found.
    other = N.accepted_points(spark, BOX, scarce, 20, 777, 5000, 3)
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, rows))


def test_short_quotas(spark):
    with pytest.raises(N.QuotaNotMet, match="of 20 places were found in 60 draws"):
        N.accepted_points(spark, BOX, scarce, 20, 50, 60, 3)
    n = scarce(N.random_points(spark, 60, 3, *BOX)).count()
    assert 0 < n < 20 and N.accepted_points(spark, BOX, scarce, 20, 50, 60, 3, partial=True).count() == n
    with pytest.raises(N.QuotaNotMet):
        N.accepted_points(spark, BOX, lambda d: d.where("false"), 20, 50, 60, 3, partial=True)


def test_windows_by_totals(spark):
    import random

    from terrasieve.operators.lookup import Grid

    r = random.Random(4)
    rows, cols = 13, 17
    cells = {(i, j): [r.choice([1.0, -9999.0, None, 2.0]) for _ in range(3)] for i in range(rows) for j in range(cols) if r.random() < 0.9}
    pixels = spark.createDataFrame([(b, i, j, v) for (i, j), vs in cells.items() for b, v in enumerate(vs)], "band int, row long, col long, v double")
    real = lambda v: v is not None and v != -9999.0
    for size in (2, 6, 12):
        for kind in N.LACKING:
            half, want = size // 2, {}
            for i in range(half, rows - half + 1):
                for j in range(half, cols - half + 1):
                    n = [sum(map(real, cells.get((a, b), []))) for a in range(i - half, i + half) for b in range(j - half, j + half)]
                    bad = {"any": sum(k < 3 for k in n), "all": sum(k == 0 for k in n), "share": sum(3 - k for k in n) / 3}[kind]
                    if bad / size**2 <= 0.5:
                        want[i, j] = bad / size**2
            got = N.interior_centres(pixels, Grid(0, 0, 1, 1, rows, cols), size, [0, 1, 2], 0.5, 10**6, 1, kind, False).collect()
            assert {(x.row, x.col): pytest.approx(x.ratio) for x in got} == want
    with pytest.raises(ValueError):
        N.interior_centres(pixels, Grid(0, 0, 1, 1, rows, cols), 3, [0], 0.5, 1, 1)


def test_paired_draw_moves_only_rows_that_may_be_drawn(spark, monkeypatch):
    """Ranges that hold no row of interest are left out before rows are moved, also where tables
    are joined by moving both sides."""
    from terrasieve.operators import running

    monkeypatch.setattr(running, "RANGE_ROWS", 500)
    rows = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 5).alias("fold"))
    want = sorted(N.paired_draw(rows, "fold", [0.1], [1, 2], "key").collect())
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = N.paired_draw(rows, "fold", [0.1], [1, 2], "key")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan and "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert len(want) == 10 * 160 and sorted(found.collect()) == want
