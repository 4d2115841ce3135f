"""Operators at sizes and in cases that the queries over the test tables do not reach."""

import random

import pytest
from pyspark.sql import functions as F
from terrasieve.functions import scalars as S
from terrasieve.operators import geo as G
from terrasieve.operators import quality as Q
from terrasieve.operators import raster as R
from terrasieve.operators import running as T
from terrasieve.operators import sampling as E
from terrasieve.operators import tables as A


def brute_totals(rows, descending):
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1] if descending else r[1], r[2]))
        total = 0
        for r in own:
            total += r[3]
            out[r[2]] = total
    return out


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize(("size", "bounds"), [(10, 128), (10, 4), (500, 128), (100_000, 128)])
def test_running_totals_over_ranges(spark, monkeypatch, size, bounds, descending):
    monkeypatch.setattr(T, "RANGE_ROWS", size)
    monkeypatch.setattr(T, "MOST_BOUNDS", bounds)
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", None, "b"]), r.choice([1.0, 1.0, 2.5, r.random() * 100, 1e9]), i, r.randrange(5)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, s double, id long, n long")
    got = {x.id: x.t for x in T.running_totals(df, ["g"], "s", ["id"], {"t": F.col("n")}, descending=descending).collect()}
    assert got == brute_totals(rows, descending)


def test_samples_over_many_ranges(spark, monkeypatch):
    rows = spark.range(3000).withColumn("k", F.col("id") % 3)
    want = sorted(map(tuple, E.sample_n(rows, ["k"], F.lit(20), 1, "id").collect()))
    monkeypatch.setattr(T, "RANGE_ROWS", 50)
    assert sorted(map(tuple, E.sample_n(rows, ["k"], F.lit(20), 1, "id").collect())) == want and len(want) == 60
    folds = E.group_folds(spark.range(200).select(F.col("id").alias("g"), (F.col("id") % 7).alias("n_pos"), (F.col("id") % 5).alias("n_neg")), "g", 5)
    sizes = folds.groupBy("fold").count().collect()
    assert len(sizes) == 5 and all(x["count"] == 40 for x in sizes)


def test_nearest_of_another_fold_however_far(spark):
    r = random.Random(2)
    rows = [(i, r.random() * 10, r.random() * 10, i % 3) for i in range(60)] + [(99, 500.0, 500.0, 0)]
    got = {x.id: x.d for x in G.nearest_of_other_fold(spark.createDataFrame(rows, "id long, x double, y double, f int"), "f", 0.3).collect()}
    for i, x, y, f in rows:
        assert got[i] == pytest.approx(min(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for _, a, b, g in rows if g != f))
    one = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 1.0, 1.0, 1)], "id long, x double, y double, f int")
    assert all(x.d is None for x in G.nearest_of_other_fold(one, "f", 0.3).collect())


def test_checks_raise(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert Q.require_columns(df, ["a"]).columns == ["a", "b"]
    for columns, exact in ((["c"], False), (["b", "a"], True)):
        with pytest.raises(ValueError, match="columns"):
            Q.require_columns(df, columns, exact)
    assert Q.check(df, {"a is 1": F.col("a") == 1}).count() == 1
    with pytest.raises(ValueError, match="a is 2"):
        Q.check(df, {"a is 2": F.col("a") == 2})
    names = spark.createDataFrame([("x.tif",), ("LandCover.tif",)], "name string")
    assert [x.name for x in R.listed(names, "landcover", 1).collect()] == ["x.tif"]
    with pytest.raises(ValueError, match="14 rasters"):
        R.listed(names, "landcover", 14)


def test_names_and_tags(spark):
    assert A.canonical(["Masked ", "none", "cross", "masked"], {"cross": "cross_channel", "masked": "masked"}) == ["masked", "cross_channel"]
    with pytest.raises(ValueError, match="unknown"):
        A.canonical(["else"], {"cross": "cross_channel"})
    rates = [1e-5, 3e-4, 0.001, 0.5, 1.0, 12.5, 2e7, 1.25e-6, 123456.0, 1234567.0]
    df = spark.createDataFrame([(x,) for x in rates], "r double").withColumn("t", S.rate_tag(F.col("r")))
    assert {x.r: x.t for x in df.collect()} == {x: f"{x:g}".replace("+", "").replace(".", "p") for x in rates}
    close = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0 + 1e-10]), ([1.0], [1.0, 2.0]), ([1.0], [1.1])], "a array<double>, b array<double>")
    assert [x.ok for x in close.select(R.all_close(F.col("a"), F.col("b")).alias("ok")).collect()] == [True, False, False]


def test_strip_banks_that_differ_are_errors(spark, tmp_path):
    from terrasieve.operators import bank as B

    path = f"{tmp_path}/strips"
    made = B.load_or_create_strips(spark, path).orderBy("perm_id").collect()
    assert [list(r.perm) for r in made][:2] == [[0, 1, 2], [0, 2, 1]] and len(made) == 6
    assert B.load_or_create_strips(spark, path).count() == 6
    B.wide(B.all_permutations(spark, 3).where("perm_id < 5"), 3).write.parquet(f"{tmp_path}/short")
    with pytest.raises(ValueError, match="is not the bank"):
        B.load_or_create_strips(spark, f"{tmp_path}/short")


def test_ties_of_very_many_rows_count_by_key(spark, monkeypatch):
    from terrasieve.operators import metrics as M

    rows = [(g, k, float(k % 3 if g else 1), int(k * 7 % 5 == 0)) for g in (0, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, k int, s double, y int")
    want = sorted((r.g, round(r.ap, 12)) for r in M.average_precision(df, ["g"], "k").collect())
    monkeypatch.setattr(M, "RANGE_ROWS", 50)
    assert sorted((r.g, round(r.ap, 12)) for r in M.average_precision(df, ["g"], "k").collect()) == want


def test_nearest_among_very_many_in_one_place(spark, monkeypatch):
    import random

    from terrasieve.operators import geo as G

    r = random.Random(2)
    others = [(i, 0.5, 0.5) for i in range(100)] + [(100 + i, r.gauss(0.5, 0.02), r.gauss(0.5, 0.02)) for i in range(400)] + [(900, 3.0, 3.0)]
    mine = [(i, r.uniform(0, 4), r.uniform(0, 4)) for i in range(60)] + [(60 + i, r.gauss(0.5, 0.03), r.gauss(0.5, 0.03)) for i in range(60)]
    frames = [spark.createDataFrame(x, "id long, x double, y double") for x in (mine, others)]
    monkeypatch.setattr(G, "DENSE", 20)
    got = {x.id: (x.other, x.d) for x in G.nearest_within(*frames, 0.7).collect()}
    for i, x, y in mine:
        d, k = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b in others)
        assert got[i] == ((k, pytest.approx(d)) if d <= 0.7 else (None, None))


def test_nearest_within_compares_few_however_many_are_around(spark, monkeypatch):
    """Points around a dense cluster: pairs don't grow with the cluster."""
    r = random.Random(8)
    cluster = [(10000 + i, 0.5 + r.gauss(0, 0.002), 0.5 + r.gauss(0, 0.002)) for i in range(3000)]
    cluster += [(20000 + i, r.random() * 3 - 1, r.random()) for i in range(20)] + [(30000, float("nan"), 0.0), (30001, None, 0.0)]
    lonely = [(i, r.random() * 3 - 1, r.random()) for i in range(200)] + [(200, 0.5, 0.5), (201, float("nan"), 0.5), (202, None, 0.5), (203, 1e30, 0.5)]
    points, others = (spark.createDataFrame(rows, "id long, x double, y double") for rows in (lonely, cluster))
    listed, plain = [], G.pairs_within

    def counted(left, right, radius, strict=False):
        listed.append(G._cells(left, radius, False).join(G._cells(right.select("x", "y"), radius, True), ["gx", "gy"]).count())
        return plain(left, right, radius, strict)

    monkeypatch.setattr(G, "pairs_within", counted)
    got = {x.id: (x.other, x.d) for x in G.nearest_within(points, others, 0.5).collect()}
    assert 0 < sum(listed) < 10_000
    assert len(got) == 204 and got[201] == got[202] == got[203] == (None, None)
    for i, x, y in lonely[:201]:
        d, other = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, o) for o, a, b in cluster[:-2])
        assert got[i] == ((other, pytest.approx(d)) if d <= 0.5 else (None, None))
