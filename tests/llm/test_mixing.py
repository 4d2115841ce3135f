import math
from collections import Counter, defaultdict

import pytest
from terrasieve.llm import mixing as M


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight int")


def corpus():
    rows, i = [], 0
    for s, n in (("hot", 300), ("b", 40), ("c", 20), (None, 10), ("d", 10)):
        for k in range(n):
            rows.append((i, " ".join(["w"] * (5 + (7 * i) % 11)), s, 1))
            i += 1
    return rows + [(9000, None, "b", 1), (9001, "", "empty", 1), (9002, "a b", "c", 1), (9002, "a b", "c", 1)]


def brute_exponent(p, target, limit):
    def stats(a):
        w = [x**a for x in p]
        w = [x / sum(w) for x in w]
        r = [x / y for x, y in zip(w, p, strict=True)]
        return -sum(x * math.log(x) for x in w) / math.log(len(p)), max(r) / min(r)

    grid = [k / 20000 for k in range(20001)]
    even = max([a for a in grid if stats(a)[0] >= target], default=0.0)
    spare = min([a for a in grid if stats(a)[1] <= limit], default=1.0)
    return max(even, spare)


@pytest.mark.parametrize(("target", "limit"), [(0.9, 100.0), (0.99, 2.0), (0.95, 1.5)])
def test_exponent(spark, target, limit):
    shares = M.source_tokens(spark.createDataFrame([(s, n) for s, n in (("a", 700), ("b", 200), ("c", 80), ("d", 20))], "source string, n_tokens long"))
    got = M.exponent(shares, target, limit)
    assert abs(got - brute_exponent([0.7, 0.2, 0.08, 0.02], target, limit)) < 1e-4


def test_every_document_appears_and_weights_hold(spark):
    rows = corpus()
    got = M.placements(docs(spark, rows), max_repetition=3.0, block_tokens=500).collect()
    times = Counter(r.doc_id for r in got)
    assert set(times) == {r[0] for r in rows}
    by, w = defaultdict(int), {}
    for r in got:
        by[r.source] += r.n_tokens
        w[r.source] = r.weight
    total = sum(by.values())
    for s in by:
        assert abs(by[s] - w[s] * total) <= 60, (s, by[s], w[s] * total)
    longest = max(len((r[1] or "").split()) for r in rows)
    for b in {r.block for r in got}:
        inside = [r for r in got if r.block == b]
        assert sorted(r.position for r in inside) == list(range(1, len(inside) + 1))
        for s in by:
            assert sum(r.n_tokens for r in inside if r.source == s) <= w[s] * 500 + longest


def test_budget_takes_a_prefix_of_each_stream(spark):
    rows = corpus()
    got = M.placements(docs(spark, rows), budget=1000, max_repetition=100.0).collect()
    by = defaultdict(int)
    for r in got:
        by[r.source] += r.n_tokens
    for s, n in by.items():
        w = next(r.weight for r in got if r.source == s)
        assert w * 1000 <= n <= w * 1000 + 16


def test_ranges_count_on(spark, monkeypatch):
    rows = corpus()
    whole = sorted(M.placements(docs(spark, rows)).drop("position").collect())
    monkeypatch.setattr(M, "RANGE_ROWS", 7)
    monkeypatch.setattr(M, "GROUP_RANGES", 3)
    assert sorted(M.placements(docs(spark, rows)).drop("position").collect()) == whole


def test_mix_keeps_columns_and_rows(spark):
    rows = corpus()
    out = M.mix(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "weight"]
    got = Counter(map(tuple, out.collect()))
    assert set(got) == set(rows) and max(got.values()) <= 4


@pytest.mark.parametrize("budget", [3, 7, 9, 40])
def test_mix_has_a_row_for_each_placement_of_equal_rows(spark, budget):
    rows = [(1, "a b c", "x", 1)] * 5 + [(2, "a b c", "x", 1), (1, "a b c", "y", 1), (1, "a b c", "y", 2), (None, None, None, None), (None, "", "x", 1)]
    how = {"budget": budget, "max_repetition": 10.0}
    key = lambda d, s: (str(d), str(s))
    want = Counter(key(r.doc_id, r.source) for r in M.placements(docs(spark, rows), **how).collect())
    got = Counter(key(r.doc_id, r.source) for r in M.mix(docs(spark, rows), **how).collect())
    assert got == want


def test_mix_with_clashing_columns(spark):
    names = ["__row", "__key", "__n", "__all", "n_tokens", "block", "key", "range", "epoch", "p"]
    rows = [(i, "a b " * i, "s", *[i] * len(names)) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = M.mix(df)
    assert out.columns == df.columns and set(map(tuple, out.collect())) == set(rows)


def test_very_long_text(spark):
    got = M.mix(docs(spark, [(1, "w " * 400_000, "a", 1), (2, "w", "b", 1)])).select("doc_id", "text").distinct().collect()
    assert sorted((r.doc_id, len(r.text)) for r in got) == [(1, 800_000), (2, 1)]


def test_empty_table(spark):
    assert M.placements(docs(spark, [])).count() == 0
    assert M.mix(docs(spark, [])).count() == 0
