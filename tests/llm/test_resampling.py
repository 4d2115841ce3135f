import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from terrasieve.llm import resampling as R

SCHEMA = "doc_id long, text string, score long, __all string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n=2):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=2, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, wanted = [0] * buckets, [0] * buckets
    for rows, counts in ((docs, own), (target, wanted)):
        for _, t in rows:
            for f in grams(t, n)[1]:
                counts[bucket(f)] += 1
    s_all, t_all = sum(own), sum(wanted)
    out = []
    for i, t in docs:
        w, fs = grams(t, n)
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets)))) for b in map(bucket, fs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    long = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(long[: 25 * len(long) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus():
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdeABCDE01é日İ") for _ in range(r.randrange(1, 9))) for _ in range(150)]
    gaps = [" ", "  ", "-", "\n", "_", ", "]
    docs = [(i, "".join(r.choice(vocab) + r.choice(gaps) for _ in range(r.randrange(0, 90)))) for i in range(250)]
    docs += [(500, None), (501, ""), (502, "--- !"), (None, docs[3][1]), (None, docs[3][1]), (2**53 + 1, docs[4][1]), (503, "x" * 500_000 + " " + "y" * 63 + " " + "z" * 64 + " q" * 30)]
    docs += [docs[7]] * 40 + [(7, docs[8][1])]
    target = [(i, " ".join(r.choice(vocab[:20]) for _ in range(60))) for i in range(30)] + [(90, None)]
    return docs, target


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 3, "x") for i, t in rows], SCHEMA)


def test_crc_of_joined_words():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 63, 64, 65, 1000, 123_457):
        a, b = rng.bytes(20), rng.bytes(n)
        got = R.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert got[0] == zlib.crc32(a + b)


def test_against_brute_force(spark, monkeypatch):
    docs, target = corpus()
    monkeypatch.setattr(R, "BLOCK", 7)
    got = R.resample(frame(spark, docs).repartition(4), frame(spark, target)).collect()
    want = brute(docs, target)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(w[4] is not None for w in want) > 30


@pytest.mark.parametrize("n", [1, 3])
def test_other_sizes(spark, monkeypatch, n):
    docs, target = corpus()
    monkeypatch.setattr(R, "SLICE_WORDS", 500)
    got = R.resample(frame(spark, docs), frame(spark, target), n=n, buckets=50).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target, n, 50)


def test_sample_keeps_all_columns(spark):
    docs, target = corpus()
    df = frame(spark, docs)
    ranks = [r for r in brute(docs, target) if r[4] is not None]
    got = R.sample(df, frame(spark, target))
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in ranks)
    by = dict(docs)
    assert all(r["__all"] == "x" and r.score == 3 and (r.text == by[r.doc_id] or r.doc_id in (7, None)) for r in got.collect())


def test_empty_tables(spark):
    docs, target = corpus()
    some, none = frame(spark, docs[:20]), frame(spark, [])
    assert R.resample(none, some).count() == 0
    assert sorted(map(tuple, R.resample(some, none).collect()), key=str) == brute(docs[:20], [])
    assert R.sample(none, some).count() == 0


def test_query(spark, sf):
    from terrasieve.llm.queries import op12_importance_resampling

    df = op12_importance_resampling(spark, sf)
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, df.collect()), key=str) == brute(docs, target)
