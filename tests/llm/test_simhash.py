import re

import numpy as np
import xxhash
from terrasieve.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string"


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    ids = list(fps)
    comp = {i: i for i in ids}
    change = True
    while change:
        change = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and comp[b] < comp[a]:
                    comp[a], change = comp[b], True
    return comp


def test_code_covers_within_radius_three():
    words, _ = S.golay()
    x = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    near = S.anchor(x)
    assert np.isin(near, words).all() and (np.bitwise_count(near ^ x) <= 3).all()


def test_replicas_reach_every_owner():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 1.0):
        words, _ = S.golay()
        deep = words[rng.random(len(words)) < share]
        x = rng.integers(0, 2**63, 40).astype(np.uint64)
        rows, keys = S.replicas(x, deep)
        sent = set(zip(rows.tolist(), keys.tolist(), strict=True))
        assert len(sent) == len(rows)
        for _ in range(50):
            y = x.copy()
            for _ in range(3):
                y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
            assert all((i, k) in sent for i, k in enumerate(S.anchor_keys(y, deep).tolist()))


def near_sets(rng):
    """Fingerprints by chance, chains of near ones, and a hot cluster of very many near ones."""
    out = [rng.integers(0, 2**63, 300).astype(np.uint64)]
    for base in out[0][:40]:
        x = base
        for _ in range(6):
            for b in rng.integers(0, 64, 3):
                x ^= np.uint64(1) << np.uint64(b)
            out.append(np.array([x]))
    hot = np.full(400, out[0][0])
    for _ in range(2):
        hot ^= np.uint64(1) << rng.integers(46, 64, len(hot)).astype(np.uint64)
    return np.unique(np.concatenate([*out, hot]))


def brute_sets(x):
    root = {int(i): int(i) for i in x}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(x):
        for b in x[k + 1 :][np.bitwise_count(x[k + 1 :] ^ a) <= 3]:
            p, q = find(int(a)), find(int(b))
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def test_places_of_every_kind_find_every_link(spark, monkeypatch):
    x = near_sets(np.random.default_rng(3))
    want = brute_sets(x)
    df = spark.createDataFrame([(int(i),) for i in x.view(np.int64)], "fp long")
    for owners, copies, pairs in ((8192, 2_000_000, 2_000_000), (1, 5_000, 700), (20, 5_000, 50_000)):
        monkeypatch.setattr(S, "OWNERS", owners)
        monkeypatch.setattr(S, "COPIES", copies)
        monkeypatch.setattr(S, "PAIRS", pairs)
        got = {r.node % 2**64: r.component % 2**64 for r in S.connected_components(S.links(df)).collect()}
        sets = {}
        for i, c in want.items():
            sets.setdefault(c, set()).add(i)
        found = {}
        for i in want:
            found.setdefault(got.get(i, i), set()).add(i)
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, found.values())), owners


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(rng.choice(vocab, int(rng.integers(1, 80))))
        rows.append((3 * i, " ".join(w)))
        if i % 3 == 0:
            rows.append((3 * i + 1, "  ".join(w).upper()))
        if i % 4 == 0:
            w[-1] = "x"
            rows.append((3 * i + 2, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (5, "a"), (5, "a")]
    got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0]).selectExpr("*", "'x' fp")).collect()
    fps = {i: brute_fp(t) for i, t in rows}
    comp = brute_components(fps)
    assert len(got) == len(rows)
    for r in got:
        assert r.fp % 2**64 == fps[r.doc_id] and r.component_id == comp[r.doc_id], r
    kept = S.keep_one(spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in comp.values()})


def test_keep_one_of_each_component(spark):
    rows = [(1, "a b c d e", 5), (1, "q r s t u", 6), (1, "a b c d e", 7), (2, "q r s t u", 8), (3, "A b  c d e", 9), (4, "z", 1), (None, "z", 2), (None, None, 3), (5, None, 4), (6, "", 4)]
    names = "doc_id long, text string, __stay int"
    df = spark.createDataFrame(rows, names).selectExpr("*", "1 fp", "2 class", "3 __all", "4 digest", "5 __id")
    out = S.keep_one(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.text) for r in out.where("doc_id is not null").collect())
    assert got == [(1, "a b c d e"), (1, "q r s t u"), (4, "z"), (5, None)]
    assert out.where("doc_id is null").count() == 2


def test_very_long_text(spark):
    t = " ".join(str(i % 977) for i in range(300_000))
    got = S.near_duplicates(spark.createDataFrame([(7, t), (3, t + " x")], "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {3} and {r.fp % 2**64 for r in got} >= {brute_fp(t)}


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_ids_beside_a_null(spark):
    ids = [2**53 + 1, None, 2**53 + 3, 2**63 - 1]
    df = spark.createDataFrame([(i, f"text number {k // 2 * 7} of its own kind {k // 2}", 1.5) for k, i in enumerate(ids)], "doc_id long, text string, fp double").coalesce(1)
    got = S.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted([(str(ids[0]), ids[0]), ("None", ids[0]), (str(ids[2]), ids[2]), (str(ids[3]), ids[2])])
    assert sorted(str(r.doc_id) for r in S.keep_one(df).collect()) == sorted(["None", str(ids[0]), str(ids[2])])


def test_of_rows_that_tie_the_same_one_stays(spark):
    rows = [(1, "a b c d", k) for k in range(20)]
    kept = {S.keep_one(spark.createDataFrame(x, "doc_id long, text string, k int").repartition(4)).first().k for x in (rows, rows[::-1])}
    assert len(kept) == 1
