import itertools
import random

import numpy as np
import pytest
from terrasieve.operators import cluster as C


def cloud(spark, n=120, seed=1):
    r = random.Random(seed)
    middles = [(0, 0), (10, 0), (0, 10), (10, 10)]
    rows = [(i, middles[i % 4][0] + r.gauss(0, 0.5), middles[i % 4][1] + r.gauss(0, 0.5)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, y double"), rows


def nearest(x, y, centres):
    return min(((x - a) ** 2 + (y - b) ** 2, k) for k, (a, b) in enumerate(centres))


def brute(rows, start):
    now = list(start)
    for _ in range(50):
        groups = {}
        for _, x, y in rows:
            groups.setdefault(nearest(x, y, now)[1], []).append((x, y))
        after = [tuple(sum(v) / len(groups[k]) for v in zip(*groups[k], strict=True)) if k in groups else c for k, c in enumerate(now)]
        moved = max(abs(a - c) for p, q in zip(now, after, strict=True) for a, c in zip(p, q, strict=True))
        now = after
        if moved <= 1e-4:
            break
    return now, sum(nearest(x, y, now)[0] for _, x, y in rows)


def test_runs_match_plain_steps(spark):
    df, rows = cloud(spark)
    starts = [[(1.0, 1.0), (9.0, 1.0), (1.0, 9.0), (9.0, 8.0)], [(0.0, 0.0), (0.1, 0.0), (0.0, 0.1), (5.0, 5.0)]]
    for (centres, inertia), start in zip(C.k_means(df, starts), starts, strict=True):
        want, total = brute(rows, start)
        assert inertia == pytest.approx(total)
        for a, b in zip(centres, want, strict=True):
            assert a == pytest.approx(b)


def test_empty_centres_are_set_anew_or_stay(spark):
    df, rows = cloud(spark)
    start = [(0.0, 0.0), (10.0, 10.0), (500.0, 500.0), (600.0, 600.0)]
    (stays, _), = C.k_means(df, [start], reseed=False)
    assert stays[2:] == start[2:]
    (moved, inertia), = C.k_means(df, [start])
    assert inertia < brute(rows, start)[1] and all(max(abs(v) for v in c) < 20 for c in moved)


def test_search_marks_the_best_seed(spark):
    df, _ = cloud(spark)
    got = C.seed_search(df, 4, range(4), restarts=3, least=10).collect()
    assert [r.seed for r in got] == [0, 1, 2, 3]
    best = [r for r in got if r.best]
    assert len(best) == 1 and best[0].inertia == min(r.inertia for r in got if r.usable)
    assert all(sum(r.sizes.values()) == 120 for r in got) and best[0].least_size == 30 and best[0].ratio == 1.0
    assert not any(r.best or r.usable for r in C.seed_search(df, 4, range(1), restarts=1, least=1000).collect())


def test_starts_are_points_and_differ(spark):
    df, rows = cloud(spark)
    found = C.start_centres(df, 4, [1, 2, 3])
    places = {(x, y) for _, x, y in rows}
    assert all(len(set(s)) == 4 and set(s) <= places for s in found) and len({tuple(s) for s in found}) == 3
    with pytest.raises(ValueError, match="no points"):
        C.start_centres(df.where("id < 0"), 2, [1])


def test_sums_of_cells_are_those_of_points(monkeypatch):
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (5, 3), (3000, 5), (3000, 1)):
        x, y = 4e6 + rng.normal(size=n) * 100, rng.normal(size=n) * 3
        x[: n // 3], y[: n // 3] = x[0], y[0]  # many points in one place
        centres = np.stack([x[rng.integers(0, n, (7, k))], y[rng.integers(0, n, (7, k))]], axis=2)
        centres[0, :] = centres[0, 0]  # centres that tie
        for size in (10**6, 50):
            monkeypatch.setattr(C, "DISTANCES", size)
            got = C.run_sums(C.pack(x, y), centres)
            for r in range(7):
                d2 = (x[:, None] - centres[r, :, 0]) ** 2 + (y[:, None] - centres[r, :, 1]) ** 2
                own = d2.argmin(axis=1)
                for i in range(k):
                    s = own == i
                    want = [s.sum(), x[s].sum(), y[s].sum(), d2[s, i].sum()]
                    assert got[r, i] == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_the_whole_search_has_the_inertias_of_plain_steps(spark):
    df, rows = cloud(spark)
    found = {r.seed: r.inertia for r in C.seed_search(df, 4, range(12), restarts=5).collect()}
    starts = C.start_centres(df, 4, [s * 1009 + r for s in range(12) for r in range(5)])
    for s in range(12):
        assert found[s] == pytest.approx(min(brute(rows, starts[5 * s + r])[1] for r in range(5)))


def test_starts_are_drawn_by_squared_distance(spark):
    """Of three places the second centre is drawn in proportion to the squared distance."""
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 2.0)], "id long, x double, y double").coalesce(1)
    found = C.start_centres(df, 2, list(range(6000)))
    first = [s for s in found if s[0] == (0.0, 0.0)]
    assert abs(len(first) / 6000 - 1 / 3) < 0.03
    assert abs(sum(s[1] == (0.0, 2.0) for s in first) / len(first) - 0.8) < 0.04


def least_cost(cost, sizes):
    """By trying every order of the slots (each cluster has as many as its size)."""
    slots = [k for k, n in enumerate(sizes) for _ in range(n)]
    return min(sum(cost[i][k] for i, k in enumerate(order)) for order in set(itertools.permutations(slots)))


@pytest.mark.parametrize("seed", range(5))
def test_capacities_hold_at_the_least_cost(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(C, "MOVES", 2)
    rows = [(2**53 + 2 * i + 1, float(r.randrange(4)) if seed == 1 else r.random() * 3, r.random()) for i in range(8)]
    centres = [(0, 0.2, 0.2), (1, 0.8, 0.7), (2, 2.5, 0.1)]
    sizes = [[4, 3, 1], [0, 4, 4], [8, 0, 0], [2, 3, 3], [1, 1, 6]][seed]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    places = spark.createDataFrame(centres, "k int, cx double, cy double")
    got, total, bound = C.exact_capacities(df, places, sizes, steps=2)
    got = got.collect()
    assert sorted(x.id for x in got) == [x[0] for x in rows] and sorted(x.k for x in got) == [k for k, n in enumerate(sizes) for _ in range(n)]
    cost = [[(x - a) ** 2 + (y - b) ** 2 for _, a, b in centres] for _, x, y in rows]
    best = least_cost(cost, sizes)
    assert total == pytest.approx(best) and sum(x.d2 for x in got) == pytest.approx(best) and bound == pytest.approx(best)
    with pytest.raises(ValueError, match="add up"):
        C.assign_capacities(df, places, [1, 1, 1])


def test_larger_assignments_prove_their_cost(spark):
    r = random.Random(9)
    df = spark.createDataFrame([(i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(3000)], "id long, x double, y double")
    places = spark.createDataFrame([(k, r.gauss(0, 1), r.gauss(0, 1)) for k in range(5)], "k int, cx double, cy double")
    got, total, bound = C.exact_capacities(df, places, [1500, 700, 500, 299, 1])
    assert total == pytest.approx(bound, rel=1e-9)
    assert {x.k: x.n for x in got.groupBy("k").agg(C.F.count("*").alias("n")).collect()} == dict(enumerate([1500, 700, 500, 299, 1]))


def test_wrong_prices_are_made_good_by_cycles(spark, monkeypatch):
    """Prices of no use leave points that have to change places."""
    r = random.Random(4)
    df = spark.createDataFrame([(i, r.random() * 3, r.random()) for i in range(60)], "id long, x double, y double")
    places = spark.createDataFrame([(0, 0.2, 0.2), (1, 0.8, 0.7), (2, 2.5, 0.1)], "k int, cx double, cy double")
    monkeypatch.setattr(C, "_first_prices", lambda *_: [0.0, 5.0, 1.0])
    assert all(type(k) is int for k in C._cycle(np.array([[0.0, -2.0], [1.0, 0.0]]), 1e-12))
    got, total, bound = C.exact_capacities(df, places, [30, 20, 10], steps=0)
    assert total == pytest.approx(bound) and sorted(x.k for x in got.collect()) == [0] * 30 + [1] * 20 + [2] * 10


def test_blocks_are_those_of_runs_that_have_ended(spark):
    """Points on a line whose centres creep on for more than fifty steps."""
    rows = [(i, (i / 3000) ** 0.5, 0.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    steps = []
    found = C.spatial_blocks(df, 24, restarts=1).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.block, []).append(r.x)
    middles = {b: sum(v) / len(v) for b, v in groups.items()}
    start, = C.start_centres(df, 24, [42 * 1009])
    x, now = np.array([r[1] for r in rows]), np.array([a for a, _ in start])
    while True:
        own = np.abs(x[:, None] - now).argmin(axis=1)
        after = np.array([x[own == k].mean() for k in range(24)])
        steps.append(np.abs(after - now).max())
        now = after
        if steps[-1] <= 1e-4:
            break
    assert len(steps) > 50 and sorted(middles.values()) == pytest.approx(sorted(now), abs=1e-3)
    assert all(abs(r.x - middles[r.block]) <= min(abs(r.x - m) for m in middles.values()) + 2.5e-4 for r in found)


def test_rules_of_capacities_hold_when_prices_are_of_no_use(spark, sf, monkeypatch):
    from terrasieve.plans.catalogue import QUERIES

    exact = C.exact_capacities
    monkeypatch.setattr(C, "_first_prices", lambda *_: [0.0, 0.3, 0.1, 0.0])
    monkeypatch.setattr(C, "exact_capacities", lambda *a: exact(*a, steps=0))
    assert [(r.n, r.gap, r.settled) for r in QUERIES["capacity_rules"](spark, sf).collect()] == [(125, 0.0, True)] * 4


def test_rules_of_capacities_hold_for_many_copies_of_few_points(spark, tmp_path):
    """Copies ask for a cluster all at once, so no prices meet the sizes and points change places."""
    from terrasieve.plans.catalogue import QUERIES

    r = random.Random(1)
    places = [[r.gauss(0, 0.3), r.gauss(0, 0.3)] for _ in range(11)]
    rows = [(i, places[r.randrange(11)], 0) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [(x.n, x.gap, x.settled) for x in QUERIES["capacity_rules"](spark, str(tmp_path)).collect()] == [(100, 0.0, True)] * 4


def test_sums_of_many_runs_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    cells, centres = C.pack(*rng.normal(size=(2, 20000))), rng.normal(size=(300, 4, 2))
    tracemalloc.start()
    C.run_sums(cells, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000
