import random
import re

import numpy as np
import pytest
from terrasieve.llm import jaccard as J

SCHEMA = "doc_id long, text string, node long, key string"


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute(rows, num=90, den=100):
    sets = [brute_set(t) for _, t in rows]
    least = [r[0] for r in rows]
    boss = list(range(len(rows)))

    def root(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                boss[root(i)] = root(j)
    groups = {}
    for i, x in enumerate(least):
        groups.setdefault(root(i), []).append(x)
    known = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((x, len(s), known[root(i)]) for i, (x, s) in enumerate(zip(least, sets, strict=True))), key=str)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA).repartition(parts)


def got(df, **how):
    return sorted(map(tuple, J.components(df, **how).collect()), key=str)


def changed(r, words, n):
    out = list(words)
    for _ in range(n):
        at = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[at] = f"n{r.randrange(9**9)}"
        elif kind == 1 and len(out) > 4:
            del out[at]
        else:
            out.insert(at, f"n{r.randrange(9**9)}")
    return out


def corpus():
    """Chains of near copies about the threshold, of all sizes; odd texts."""
    r = random.Random(11)
    rows, i = [], 0
    for size in [3, 4, 8, 9, 10, 11, 12, 13, 14, 16, 21, 22, 23, 30, 40, 60, 90, 150, 400, 900]:
        for _ in range(6):
            words = [f"w{r.randrange(300)}" for _ in range(size)]
            for _ in range(7):
                rows.append((i, " ".join(words)))
                i += 1
                words = changed(r, words, r.randrange(0, max(2, size // 28)))
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One two"), (9004, "one  TWO"), (9005, "one"), (None, rows[3][1]), (None, "alone here in the night"), (None, "alone here in the night")]
    rows += [(2**53 + 1, rows[50][1]), (2**53 + 1, rows[200][1]), (9006, "İx é ab ab ab ab ab"), *[rows[77]] * 30, (9007, "long " * 200_000 + "end of it")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("num", "den"), [(90, 100), (1, 2), (1, 1)])
def test_linked_sets_share_a_signature(num, den):
    rng = np.random.default_rng(4)
    for size in [1, 2, 9, 10, 14, 15, 25, 80, 333]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            gone = int(rng.integers(0, max(1, size // 8) + 1))
            b = np.unique(np.append(a[gone:], rng.integers(0, 2**63, int(rng.integers(0, max(1, size // 10) + 1))).astype(np.uint64)))
            both = len(np.intersect1d(a, b))
            if den * both < num * (len(a) + len(b) - both) or len(b) == 0 or both == len(a) == len(b):
                continue
            assert J._alike(a.tobytes(), b.tobytes(), num, den)
            band = J.band_of(max(len(a), len(b)), num, den)
            assert J.band_of(min(len(a), len(b)) * den // num, num, den) >= band
            (x, y), (s, t) = J.signatures([a, b], band, num, den)
            assert set(x) & set(y)
            bits = int(np.bitwise_count((s ^ t).view(np.uint64)).sum())
            assert bits <= len(a) + len(b) - 2 * both <= J.most_apart(len(a), len(b), num, den)


def test_against_brute_force(spark):
    rows = corpus()
    assert got(frame(spark, rows)) == brute(rows)


def test_small_slices_and_few_candidates(spark, monkeypatch):
    rows = corpus()
    for name, value in {"SLICE": 3, "FIRST": 1, "MORE": 2, "SHARE": 2, "TASK_ROWS": 500, "PAIRS": 8, "SLICE_SHINGLES": 200}.items():
        monkeypatch.setattr(J, name, value)
    assert got(frame(spark, rows, 3)) == brute(rows)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text, each with a word of its own, and a chain that hangs on one of them."""
    r = random.Random(2)
    monkeypatch.setattr(J, "SLICE", 50)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(changed(r, base, 1 + i % 2))) for i in range(400)]
    words = rows[399][1].split()
    for i in range(400, 420):
        words = changed(r, words, 2)
        rows.append((i, " ".join(words)))
    want = brute(rows)
    assert len({c for _, _, c in want}) > 1 and sum(c == 0 for _, _, c in want) > 400
    assert got(frame(spark, rows)) == want


def test_another_threshold(spark):
    rows = corpus()[:400]
    assert got(frame(spark, rows), num=3, den=4) == brute(rows, 3, 4)


def test_empty_tables(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(1, None), (2, "")])) == [(1, 0, 1), (2, 0, 2)]


def test_query(spark, sf):
    from terrasieve.llm.queries import op11_jaccard_join

    df = op11_jaccard_join(spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, df.collect()), key=str) == brute(rows)
