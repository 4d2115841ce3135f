"""Tables by commits: what a crash between writes leaves, and builds that are made once."""

import os

import pytest
from pyspark.sql import functions as F
from terrasieve.sinks import results as K
from terrasieve.sinks import snapshots as S

SCHEMA = "seed int, rate double, auc double"


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def table(spark, path):
    return sorted(map(tuple, S.read(spark, path).select("seed", "rate", "auc").collect()), key=str)


def test_appending_keeps_the_last_row_and_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert S.read(spark, path) is None
    many = spark.createDataFrame([(1, None, float(v), v) for v in range(8)], SCHEMA + ", v int").repartition(4)
    assert S.append_new(many, path, ["seed", "rate"], ["v"]) == 1
    assert table(spark, path) == [(1, None, 7.0)]
    assert S.append_new(many, path, ["seed", "rate"], ["v"]) == 0
    assert S.append_new(many.withColumn("seed", F.lit(2)), path, ["seed", "rate"], ["v"]) == 1
    assert table(spark, path) == [(1, None, 7.0), (2, None, 7.0)]
    assert K.append_new(many, f"{tmp_path}/plain", ["seed", "rate"], ["v"]) == 1
    assert spark.read.parquet(f"{tmp_path}/plain").first().v == 7


def test_jobs_replace_their_own_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    S.replace_jobs(rows(spark, (1, 0.5, 0.1), (2, 0.5, 0.2), (2, 0.5, 0.3), (3, None, 0.4)), path, ["seed", "rate"])
    S.replace_jobs(rows(spark, (2, 0.5, 0.9), (3, None, 0.8), (4, 1e-5, 0.7)), path, ["seed", "rate"])
    assert table(spark, path) == [(1, 0.5, 0.1), (2, 0.5, 0.9), (3, None, 0.8), (4, 1e-05, 0.7)]
    assert S.vacuum(spark, path) == 0 and S.read(spark, path).schema["rate"].dataType.simpleString() == "double"
    S.replace_jobs(rows(spark, (1, 0.5, 0.0), (2, 0.5, 0.0), (3, None, 0.0), (4, 1e-5, 0.0)), path, ["seed", "rate"])
    assert S.vacuum(spark, path) == 2
    assert [r[2] for r in table(spark, path)] == [0.0] * 4


def test_a_write_that_is_killed_half_way(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    S.replace(rows(spark, (1, 0.5, 0.1)), path)
    before = table(spark, path)
    # Killed while rows are written: a task fails after others have left their files.
    broken = rows(spark, *[(i, 0.5, 0.1) for i in range(2, 9)]).repartition(4).withColumn("auc", F.when(F.col("seed") == 5, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("auc")))
    with pytest.raises(Exception, match="killed"):
        S.replace_jobs(broken, f"{tmp_path}/jobs", ["seed"])
    with pytest.raises(Exception, match="killed"):
        S.append_new(broken, path, ["seed"], ["auc"])
    assert table(spark, path) == before and S.read(spark, f"{tmp_path}/jobs") is None
    # Killed between the rows and the commit.
    with monkeypatch.context() as m:
        m.setattr(S._Files, "rename", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            S.append_new(rows(spark, (9, 0.5, 0.5)), path, ["seed"], ["auc"])
    assert table(spark, path) == before
    assert S.append_new(rows(spark, (9, 0.5, 0.5)), path, ["seed"], ["auc"]) == 1
    assert table(spark, path) == [*before, (9, 0.5, 0.5)]
    assert S.vacuum(spark, path) >= 1 and table(spark, path) == [*before, (9, 0.5, 0.5)]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    S.replace(rows(spark, (1, 0.5, 0.1)), path)
    stale = S._newest(spark, path)
    S.append_new(rows(spark, (2, 0.5, 0.2)), path, ["seed"], ["auc"])
    with monkeypatch.context() as m:
        m.setattr(S, "_newest", lambda *a: stale)
        with pytest.raises(S.Conflict):
            S.append_new(rows(spark, (3, 0.5, 0.3)), path, ["seed"], ["auc"])
    assert table(spark, path) == [(1, 0.5, 0.1), (2, 0.5, 0.2)]


def test_a_table_from_itself(spark, tmp_path):
    path = f"{tmp_path}/t"
    S.replace(rows(spark, (1, 0.5, 0.1), (2, 0.5, 0.2)), path)
    S.replace(S.read(spark, path).where("seed = 2"), path)
    assert table(spark, path) == [(2, 0.5, 0.2)]


def test_builds_are_made_once_for_given_inputs(spark, tmp_path):
    source, path, times = f"{tmp_path}/in.parquet", f"{tmp_path}/masks", []

    def build():
        times.append(1)
        return spark.read.parquet(source).select((F.col("seed") > 1).alias("m"))

    def ask(limit=1):
        return sorted(r.m for r in S.read_or_build(spark, path, [source], {"limit": limit}, build).collect())

    rows(spark, (1, 0.5, 0.1), (2, 0.5, 0.2)).coalesce(1).write.parquet(source)
    assert ask() == ask() == [False, True] and len(times) == 1
    assert ask(limit=2) == [False, True] and len(times) == 2  # other settings
    rows(spark, (3, 0.5, 0.1)).coalesce(1).write.mode("overwrite").parquet(source)
    assert ask() == [True] and len(times) == 3  # other input
    assert not [n for n in os.listdir(path) if n.startswith("_draft")]


def test_a_broken_build_does_not_count(spark, tmp_path):
    source, path = f"{tmp_path}/in.parquet", f"{tmp_path}/masks"
    rows(spark, (1, 0.5, 0.1)).write.parquet(source)
    with pytest.raises(Exception, match="killed"):
        S.read_or_build(spark, path, [source], {}, lambda: spark.range(3).select(F.raise_error(F.lit("killed")).alias("m")))
    assert S.read_or_build(spark, path, [source], {}, lambda: spark.range(3)).count() == 3


def test_halves_and_common_index(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=200) * 10.0 ** rng.integers(-9, 6, 200), [0.0, -0.0, 65504, 65519.99, 65520, -70000, 1.0, 2048, 2049, 2**-24, 2**-25, 1e-9, np.inf, np.nan]])
    with np.errstate(over="ignore"):
        want = v.astype(np.float16).astype(float)
    got = [r.h for r in spark.createDataFrame([(float(x),) for x in v], "v double").coalesce(1).select(K.half(F.col("v")).alias("h")).collect()]
    np.testing.assert_array_equal(np.array(got), want)
    index = spark.createDataFrame([(i, s, not (i == 2 and s == 16)) for i in range(4) for s in (8, 16)], "id int, patch_size int, valid_patch boolean")
    assert K.write_common(index, f"{tmp_path}/c", "id", [8, 16]) == 3
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/c/ids").collect()) == [0, 1, 3]
    assert sorted((r.id, r.patch_size) for r in spark.read.parquet(f"{tmp_path}/c/index").collect()) == [(i, s) for i in (0, 1, 3) for s in (8, 16)]
    with pytest.raises(ValueError, match="repeated"):
        K.write_common(index.union(index.limit(1)), f"{tmp_path}/d", "id", [8, 16])
    assert not os.path.exists(f"{tmp_path}/d")
