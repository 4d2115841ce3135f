"""Bags and forests: draws against plain ranks, splits against every split there is."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from terrasieve.operators import forest as R
from terrasieve.operators import pu as P
from terrasieve.operators import sampling as E
from terrasieve.plans.catalogue import QUERIES


def test_forest_query_has_the_references_defaults(spark, sf, monkeypatch):
    calls = []

    class Stop(Exception):
        pass

    def stop(rows, trees, depth, seed, size, iterations, features):
        assert rows.select("iteration").distinct().count() == iterations
        calls.append((iterations, trees, depth, size, features))
        raise Stop

    monkeypatch.setattr(P, "train", stop)
    with pytest.raises(Stop):
        QUERIES["random_forest_pu"](spark, sf)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").where("label = 0").count()
    assert calls == [(50, 100, 30, 2 * n, 64)]


@pytest.mark.parametrize("m", [1, 7, 250, 499, 500, 600, 0])
def test_bags_are_the_first_by_digest(spark, m):
    df = spark.range(500).withColumnRenamed("id", "k").repartition(3)
    got = {(r.k, r.iteration) for r in E.bags(df, 3, m, 9, "k").where("in_bag").collect()}
    want = set()
    for i in range(3):
        order = sorted(range(500), key=lambda k: (hashlib.md5(f"9|{i}|{k}".encode()).hexdigest(), k))
        want |= {(k, i) for k in order[:m]}
    assert got == want and E.bags(df, 3, m, 9, "k").count() == 1500


def test_an_edge_far_from_its_place_is_found(spark):
    """Digests that are not even at all: the window is widened until it holds the edge."""
    rows = [(0, k, f"{k:032d}", 0.5 + k / 1e6) for k in range(400)] + [(1, k, f"{k:032d}", k / 400) for k in range(400)]
    df = spark.createDataFrame(rows, "iteration int, k long, __digest string, __head double")
    assert {r["__of"]: r["__edge"]["__key"] for r in E._edges(df, 400, 5, "k").collect()} == {0: 4, 1: 4}


def gini_best(codes, y, w, features):
    best = None
    for f in features:
        for c in sorted(set(codes[:, f]))[:-1]:
            left = codes[:, f] <= c
            score = sum(((w * y)[s].sum() ** 2 + (w * (1 - y))[s].sum() ** 2) / w[s].sum() for s in (left, ~left))
            if best is None or score > best[0] * (1 + 1e-12):
                best = (score, f, c)
    return (-1, -1) if best is None else best[1:]


def test_splits_against_every_split():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n, nodes = int(rng.integers(2, 60)), int(rng.integers(1, 5))
        codes, y = rng.integers(0, int(rng.integers(2, 30)), (n, 6)).astype(np.uint8), rng.integers(0, 2, n).astype(float)
        row = rng.integers(0, n, 80)
        slot, w = rng.integers(0, nodes, 80), rng.integers(1, 4, 80).astype(float)
        features = np.stack([rng.permutation(6)[:3] for _ in range(nodes)])
        f, c = R.best_splits(codes, y, row, w, slot, features)
        for s in range(nodes):
            own = slot == s
            assert (f[s], c[s]) == gini_best(codes[row[own]], y[row[own]], w[own], features[s])


def test_a_tree_node_by_node():
    """Every inner node splits its own rows at their best place, leaves are pure or deep enough."""
    rng = np.random.default_rng(4)
    codes, y = rng.integers(0, 40, (150, 5)).astype(np.uint8), rng.integers(0, 2, 150).astype(float)
    ids = rng.integers(0, 2**63, 150).astype(np.uint64)
    for depth in (0, 3, 30):
        seeds = [R._seeded(1, t) for t in range(4)]
        m = R.grow(codes, y, ids, seeds, depth, 5)
        total = np.zeros(150)
        for t, seed in enumerate(seeds):
            w = R.times_drawn(ids, seed).astype(float)
            todo = [(t, np.flatnonzero(w), 0)]
            while todo:
                node, rows, level = todo.pop()
                assert m["value"][node] == pytest.approx((w * y)[rows].sum() / w[rows].sum())
                if m["feature"][node] < 0:
                    pure = len(set(y[rows])) == 1 or len(np.unique(codes[rows], axis=0)) == 1
                    assert pure or level == depth
                    continue
                best = gini_best(codes[rows], y[rows], w[rows], range(5))
                at = lambda f, c: sum(((w * y)[s].sum() ** 2 + (w * (1 - y))[s].sum() ** 2) / w[s].sum() for s in (rows[codes[rows, f] <= c], rows[codes[rows, f] > c]))  # noqa: E731, B023
                assert at(m["feature"][node], m["code"][node]) == pytest.approx(at(*best))
                right = codes[rows, m["feature"][node]] > m["code"][node]
                todo += [(m["left"][node], rows[~right], level + 1), (m["left"][node] + 1, rows[right], level + 1)]
            for i in range(150):
                node = t
                while m["feature"][node] >= 0:
                    node = m["left"][node] + int(codes[i, m["feature"][node]] > m["code"][node])
                total[i] += m["value"][node]
        assert R.predicted(m, 4, codes) == pytest.approx(total)
    # Trees don't depend on which others grow beside them.
    alone = R.grow(codes, y, ids, seeds[2:3], 30, 2)
    both = R.grow(codes, y, ids, seeds[1:3], 30, 2)
    assert R.predicted(both, 2, codes) - R.predicted(R.grow(codes, y, ids, seeds[1:2], 30, 2), 1, codes) == pytest.approx(R.predicted(alone, 1, codes))


def test_draws_have_the_mean_and_spread_of_a_sample_with_replacement():
    n = R.times_drawn(np.arange(200_000, dtype=np.uint64), R._seeded(5))
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02 and abs((n == 0).mean() - np.exp(-1)) < 0.005


def fixture(spark):
    r = random.Random(3)
    near = [(i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(40)]
    rest = [(100 + i, *((r.gauss(0, 1), r.gauss(0, 1)) if i % 4 == 0 else (r.gauss(6, 1), r.gauss(6, 1)))) for i in range(80)]
    return near, rest, *(spark.createDataFrame(x, "id long, a double, b double") for x in (near, rest))


def test_small_forests_score_what_was_not_drawn(spark):
    _, rest, positives, unlabeled = fixture(spark)
    scored = P.bagged_scores(positives, unlabeled, ["a", "b"], "id", 3, 40, trees=10, depth=5)
    drawn = P.bags(unlabeled, 3, 40, 42, "id").where("not in_bag").select("id", "iteration").collect()
    got = scored.collect()
    assert sorted((x.id, x.iteration) for x in got) == sorted(map(tuple, drawn)) and all(0 <= x.p <= 1 for x in got)
    votes = P.tally_votes(scored, "id", "p", 0.5)
    kept = {x.id for x in P.reliable_negatives(votes, 0.5).collect()}
    like = {i for i, a, b in rest if a < 3}
    assert kept and len(kept & like) <= 2
    low = P.low_scored(votes, 0.5).where(F.col("times") > 0)
    assert {x.id for x in low.collect()} >= kept - like


def test_scores_are_the_same_however_work_is_dealt(spark, monkeypatch):
    _, _, positives, unlabeled = fixture(spark)
    ask = lambda: sorted((x.id, x.iteration, round(x.p, 9)) for x in P.bagged_scores(positives, unlabeled, ["a", "b"], "id", 2, 30, trees=7).collect())
    first = ask()
    monkeypatch.setattr(R, "TREES", 2)
    monkeypatch.setattr(R, "SCORED", 9)
    assert ask() == first
    # Upper trees from histograms, lower ones in tasks; and all of them from histograms.
    monkeypatch.setattr(R, "LOCAL_ROWS", 12)
    monkeypatch.setattr(R, "OPEN", 9)
    assert ask() == first
    monkeypatch.setattr(R, "LOCAL_ROWS", 0)
    assert ask() == first


def test_scores_match_a_library_of_forests(spark):
    """Mean scores of the same bags are near those of MLlib's forests."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    _, rest, positives, unlabeled = fixture(spark)
    own = {(x.id, x.iteration): x.p for x in P.bagged_scores(positives, unlabeled, ["a", "b"], "id", 1, 40, trees=60).collect()}
    together = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    bag = P.bags(unlabeled, 1, 40, 42, "id")
    train = positives.withColumn("y", F.lit(1.0)).unionByName(bag.where("in_bag").select("id", "a", "b").withColumn("y", F.lit(0.0)))
    model = RandomForestClassifier(numTrees=60, maxDepth=30, labelCol="y", seed=1).fit(together.transform(train))
    other = model.transform(together.transform(bag.where("not in_bag"))).select("id", vector_to_array("probability")[1].alias("p")).collect()
    gap = [abs(own[x.id, 0] - x.p) for x in other]
    assert len(gap) == len(own) and np.mean(gap) < 0.08


def test_trees_take_few_sorts():
    """A tree of 20,000 rows takes no longer than twenty sorts of its rows by code."""
    rng = np.random.default_rng(5)
    codes, y = rng.integers(0, 256, (20_000, 64)).astype(np.uint8), rng.integers(0, 2, 20_000).astype(float)
    ids = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    key = rng.integers(0, 2**30, 8 * 12_600)

    def least(f):
        took = []
        for _ in range(4):
            began = time.perf_counter()
            f()
            took.append(time.perf_counter() - began)
        return min(took)

    assert least(lambda: R.grow(codes, y, ids, [R._seeded(1)], 30, 8)) < 20 * least(lambda: np.argsort(key, kind="stable"))


def test_nodes_split_alike_from_counts_and_from_order(monkeypatch):
    """Whatever a node's size and however few nodes are looked at together, trees are the same."""
    rng = np.random.default_rng(6)
    codes, y = rng.integers(0, 30, (900, 12)).astype(np.uint8), rng.integers(0, 2, 900).astype(float)
    codes[:, :9] //= 15  # often the drawn features tell no rows apart, or equally well
    ids, seeds = rng.integers(0, 2**63, 900).astype(np.uint64), [R._seeded(2, t) for t in range(3)]
    first = R.grow(codes, y, ids, seeds, 30, 3)
    for many, at_once in ((1, 32_768), (10**6, 32_768), (20, 1), (20, 700)):
        monkeypatch.setattr(R, "MANY", many)
        monkeypatch.setattr(R, "AT_ONCE", at_once)
        other = R.grow(codes, y, ids, seeds, 30, 3)
        assert all(np.array_equal(first[c], other[c]) for c in R.KINDS)


def test_trees_are_sent_small_and_few_at_a_time(spark, monkeypatch):
    """A node takes 7 bytes or so of a sent tree (a leaf's value and no children), and the trees
    that come back are those that were grown."""
    monkeypatch.setattr(R, "BESIDE", 200)
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 9, (80, 6)).astype(np.uint8)
    data = [(i, j, j % 2, bytearray(codes[j].tobytes())) for i in range(2) for j in range(80)]
    rows = spark.createDataFrame(data, "iteration int, row long, y int, codes binary")
    found = R.train(rows, 12, 30, 3, 80, 2, 6).models.collect()
    assert max(m.roots for m in found) <= 2 and all(sum(m.roots for m in found if m.iteration == i) == 12 for i in range(2))
    sent = sum(len(v) for m in found for v in m if isinstance(v, bytes | bytearray))
    assert sent <= 8 * sum(len(m.feature) // 2 for m in found)
    got, total = sum(R.predicted(R._model(m.asDict()), m.roots, codes) for m in found if m.iteration == 1), np.zeros(80)
    order = np.array([m[1] for m in data[80:]])
    for t in range(12):
        grown = R.grow(codes[order], np.arange(80) % 2.0, order.astype(np.uint64), [R._seeded(3, 1, t)], 30, 2)
        total += R.predicted(grown, 1, codes)
    assert got == pytest.approx(total)


def test_rows_are_not_written_for_each_iteration(spark, monkeypatch):
    """Who is drawn is told from digests; no table holds every row once for each iteration."""
    _, _, positives, unlabeled = fixture(spark)
    sizes = []

    def kept(df):
        out = held(df)
        sizes.append(out.count())
        return out

    held = P.kept
    for module in (P, R, E):
        monkeypatch.setattr(module, "kept", kept, raising=False)
    assert P.bagged_scores(positives, unlabeled, ["a", "b"], "id", 6, 40, trees=3, depth=4).count() == 6 * 40
    assert max(sizes) <= 80
