import json

import pytest
from pyspark.sql import functions as F
from terrasieve.operators import bank as B
from terrasieve.sinks import results as K
from terrasieve.sources import points as P


def rows(spark, *values):
    return spark.createDataFrame(values, "seed int, rate double, auc double")


def test_a_second_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    first = rows(spark, (1, 0.1, 0.7), (2, None, 0.8))
    assert K.append_new(first, path, ["seed", "rate"], ["auc"]) == 2
    assert K.append_new(first, path, ["seed", "rate"], ["auc"]) == 0
    assert K.append_new(rows(spark, (2, None, 0.9), (3, None, 0.6), (3, None, 0.6)), path, ["seed", "rate"], ["auc"]) == 1
    assert sorted((r.seed, r.auc) for r in spark.read.parquet(path).collect()) == [(1, 0.7), (2, 0.8), (3, 0.6)]


def test_jobs_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    K.replace_jobs(rows(spark, (1, 0.1, 0.5), (2, 0.1, 0.6)), path, ["seed"])
    K.replace_jobs(rows(spark, (2, 0.1, 0.7), (2, 0.2, 0.8)), path, ["seed"])
    assert sorted((r.seed, r.auc) for r in spark.read.parquet(path).collect()) == [(1, 0.5), (2, 0.7), (2, 0.8)]
    K.rewrite_deduplicated(spark, path, str(tmp_path / "u"), ["seed"], ["rate"])
    assert sorted((r.seed, r.auc) for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [(1, 0.5), (2, 0.8)]


def test_nothing_is_written_if_a_rule_is_broken(spark, tmp_path):
    path, good = str(tmp_path / "t"), rows(spark, (1, 0.1, 0.5))
    rules = {"auc in range": F.col("auc").between(0, 1)}
    with pytest.raises(ValueError, match="auc in range"):
        K.write_checked(rows(spark, (1, 0.1, 1.5)), path, rules, ["seed", "auc"])
    assert not K.exists(spark, path)
    K.write_checked(good, path, rules, ["seed", "auc"], "csv")
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("1", "0.5")]


def test_arrays_come_back_as_pixels(spark, tmp_path):
    cells = [(i, b, r, c, float(i * 100 + b * 10 + r * 2 + c)) for i in range(3) for b in range(2) for r in range(2) for c in range(2)]
    df = spark.createDataFrame(cells, "id long, band long, row long, col long, v double")
    K.write_arrays(df, str(tmp_path / "a"), 2, 2)
    assert sorted(map(tuple, K.read_arrays(spark, str(tmp_path / "a")).collect())) == cells


def test_manifest_index_and_experiment(spark, tmp_path):
    index = spark.createDataFrame([(1, 16), (1, 32), (2, 32)], "id int, patch_size int")
    K.write_index(index, str(tmp_path / "index"))
    assert spark.read.parquet(f"{tmp_path}/index/patch_size=32").count() == 2
    K.write_experiment(str(tmp_path / "x"), ["seed"], metrics=rows(spark, (1, 0.1, 0.5)), log=rows(spark, (1, 0.1, 0.4)))
    made = json.loads(K.manifest(spark, {"metrics": f"{tmp_path}/x/metrics"}, {"b": 1, "a": 2}).first()[0])
    assert made["tables"]["metrics"]["rows"] == 1 and made["settings"] == {"a": 2, "b": 1}


def test_markdown(spark, tmp_path):
    lines = K.markdown(rows(spark, (2, None, 0.5), (1, 0.25, 0.12345)), {"seed": "%s", "rate": "%.1e", "auc": "%.3f"}, "seed")
    assert [r.line for r in lines.collect()] == ["| seed | rate | auc |", "|---|---|---|", "| 1 | 2.5e-01 | 0.123 |", "| 2 | - | 0.500 |"]
    K.write_text(lines, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).count() == 4


def test_features_are_read_again(spark, tmp_path):
    points = spark.createDataFrame([(-80.5, 37.5, "slide"), (-81.0, 38.0, None)], "lon double, lat double, kind string")
    K.write_text(K.feature_collection(points, ["kind"]), str(tmp_path / "g"))
    got = P.read_geojson(spark, str(tmp_path / "g")).collect()
    assert sorted((r.lon, r.lat) for r in got) == [(-81.0, 38.0), (-80.5, 37.5)] and {r.point_id for r in got} == {"P_00000", "P_00001"}
    assert json.loads(K.features(points, ["kind"]).first()[0])["geometry"]["type"] == "Point"


def test_features_that_are_no_points_are_left_out(spark, tmp_path):
    line = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": None}, "properties": {}}
    point = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"a": "b"}}
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [line, point]}))
    got = P.read_geojson(spark, str(tmp_path / "f.geojson")).collect()
    assert [(r.point_id, r.lon, r.lat, r.properties) for r in got] == [("P_00001", 1.0, 2.0, {"a": "b"})]


def test_result_files(spark, tmp_path):
    for where, auc in (("armA/run1", 0.5), ("armB/run1", 0.6), ("armB_smoke/run1", 0.9)):
        folder = tmp_path / where
        folder.mkdir(parents=True)
        (folder / "metrics.csv").write_text(f"seed,auc\n1,{auc}\n")
    got = P.read_result_files(spark, str(tmp_path), "seed int, auc double", "smoke")
    assert sorted((r.tag, r.auc) for r in got.collect()) == [("armA", 0.5), ("armB", 0.6)]
    ranks = {r.file.split("/")[-3]: r.file_rank for r in P.file_ranks(got).collect()}
    assert ranks == {"armA": 1, "armB": 2}
    sizes = P.read_by_size(spark, {16: f"{tmp_path}/armA/run1/metrics.csv", 32: f"{tmp_path}/armB/run1/metrics.csv"})
    assert sorted((r.patch_size, r.seed, r.auc) for r in sizes.collect()) == [(16, 1, 0.5), (32, 1, 0.6)]
    assert [r.auc for r in P.first_rows(sizes, ["auc"], 1).collect()] == [0.5]


def test_point_files():
    assert P.point_file(["landslide_b.csv", "landslide_points.csv"]) == "landslide_points.csv"
    assert P.point_file(["Landslide_x.CSV", "other.csv"]) == "Landslide_x.CSV"
    for names in ([], ["landslide_a.csv", "landslide_b.csv"]):
        with pytest.raises(ValueError, match="one file"):
            P.point_file(names)


def test_samples(spark):
    df = spark.createDataFrame([("3", "1", "a", 1.0), ("1", "2", "", 2.0), ("2", "2", None, -9999.0), ("n/a", "2", "d", 1.0), ("2", "9", None, 5.0)], "LON string, Lat string, sample_id string, f0 double")
    got = P.samples(df, 1, "inventory", "L", ["f0"]).orderBy("x").collect()
    assert [(r.sample_id, r.x, r.f0, r.label, r.source) for r in got] == [("L_000001", 1.0, 2.0, 1, "inventory"), ("L_000002", 2.0, 5.0, 1, "inventory"), ("a", 3.0, 1.0, 1, "inventory")]
    assert P.optional_points(spark, None, "x double, y double").count() == 0
    with pytest.raises(ValueError, match="missing"):
        P.samples(df, 1, "i", "L", ["f1"])


def test_bank_is_diverse_and_survives_its_file(spark, tmp_path):
    pool = B.candidates(spark, 5, 300, 1)
    bank = B.diverse(pool, 12).collect()
    perms = [r.perm for r in bank]
    assert all(sorted(p) == list(range(5)) for p in perms) and len({tuple(p) for p in perms}) == 12
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    every = [r.perm for r in pool.orderBy("id").collect()]
    chosen = [every[0]]
    for r in bank[1:]:  # each is as far from those before it as any candidate is
        far = max(min(apart(p, c) for c in chosen) for p in every if p not in chosen)
        assert r.distance == far == min(apart(r.perm, c) for c in chosen)
        chosen.append(r.perm)
    df = spark.createDataFrame(bank)
    B.wide(df, 5).write.parquet(str(tmp_path / "b"))
    back = B.from_wide(spark.read.parquet(str(tmp_path / "b")))
    assert sorted((r.perm_id, r.perm) for r in back.collect()) == sorted((r.perm_id, r.perm) for r in bank)
    assert B.broken(back, 5, 12).where("n > 0").count() == 0
    drawn = B.shuffled_by_bank(spark.range(50).withColumnRenamed("id", "k"), "k", back, 3).collect()
    assert len(drawn) == 50 and all(r.perm == perms[r.perm_id] for r in drawn)
    with pytest.raises(ValueError, match="fewer"):
        B.diverse(pool.limit(3), 4)
