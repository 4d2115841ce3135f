import hashlib
import random
import re

import xxhash
from terrasieve.llm import winnow as W


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hash_longs(values):
    """Spark chains xxhash64 over columns: each column's hash is the next one's seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
    return seed


def brute(text):
    h = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in re.findall(W.TOKEN, text)]
    grams = [hash_longs([h[i - k] if i >= k else 0 for k in range(W.GRAM)]) >> 28 for i in range(len(h))]
    out = []
    for i in range(len(grams)):
        own = range(max(0, i - W.WINDOW + 1), i + 1)
        j = min(own, key=lambda p: (grams[p], -p))
        if (grams[j], j) not in out:
            out.append((grams[j], j))
    return out


def jaccard(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i * 37, "".join(r.choice(["ab ", "x", "é", "longer-than-eight ", "\n", "the "]) for _ in range(r.randrange(0, 150)))) for i in range(60)]
    rows += [(100000, "z" * 40000), (100001, None), (100002, ""), (100003, "a a a a a a a a a a a a")]
    got = {x.doc_id: x for x in W.compare(spark.createDataFrame([(a, b, "q") for a, b in rows], "doc_id long, text string, kept string")).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        a, b = brute(t), brute(edited)
        x = got[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert x.fingerprint == ",".join(f"{h:x}@{p}" for h, p in a)
        assert x.edited_fingerprint == ",".join(f"{h:x}@{p}" for h, p in b)
        assert abs(x.near_edited - jaccard(a, b)) < 1e-12 and abs(x.near_next - jaccard(a, brute(nxt))) < 1e-12


def test_match_guarantee():
    r = random.Random(1)
    shared = [f"s{i}" for i in range(W.WINDOW + W.GRAM - 1)]
    for _ in range(50):
        a, b = ([f"{c}{r.random():.5f}"[:8] for _ in range(20)] for c in "ab")
        a[7:7], b[3:3] = shared, shared
        assert {h for h, _ in brute(" ".join(a))} & {h for h, _ in brute(" ".join(b))}


def test_nulls_ties_and_empty(spark):
    rows = [(None, "p q r s"), (5, "b"), (5, "a"), (5, "a"), (9, "c c c")]
    got = sorted(W.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(None, "p q r s", "a"), (5, "b", "c c c"), (5, "a", "c c c"), (5, "a", "c c c"), (9, "c c c", "a")], key=str)
    assert [tuple(x) for x in W.with_next(spark.createDataFrame([(None, "x")], "doc_id long, text string")).collect()] == [(None, "x", "x")]
    assert W.compare(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ranges_keep_order_and_bear_far_ids(spark):
    from terrasieve.llm.common import id_ranges

    r = random.Random(7)
    ids = sorted({r.randrange(1000) for _ in range(300)} | {10**6 + k for k in range(200)} | {-(2**62), 2**62, 2**53 + 1, 2**53 + 2})
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id long")
    number, following, least = id_ranges(df, per_range=10, segments=16)
    of = {x.doc_id: x.n for x in df.where("doc_id is not null").select("doc_id", number.alias("n")).collect()}
    seen = [of[i] for i in ids]
    assert least == ids[0] and seen == sorted(seen)
    held = sorted(set(seen))
    assert {x["range"]: x.following for x in following.collect()} == dict(zip(held, [*held[1:], held[0]], strict=True))
    assert max(seen.count(n) for n in held) <= 60
    for few in ([], [(5,)], [(5,), (5,)], [(None,)]):
        number, following, _ = id_ranges(spark.createDataFrame(few, "doc_id long"))
        assert following.count() == len({x for (x,) in few if x is not None})
