import random
from collections import Counter

from terrasieve.llm import repeats as R


def brute(rows, length=R.LENGTH):
    data = [(t or "").encode() for _, t in rows]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = [False] * len(d)
        for a in range(len(d) - length + 1):
            if n[d[a : a + length]] > 1:
                gone[a : a + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def fixture():
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefé \n") for _ in range(n))
    shared = [text(n) for n in (150, 190, 199, 200, 201, 260, 700, 1500)]
    rows = [(i, "".join(r.choice([text(r.randrange(0, 400)), r.choice(shared)]) for _ in range(r.randrange(1, 6)))) for i in range(60)]
    base = text(2500)
    rows += [(100 + i, base[:k] + "#" + base[k + 1 :]) for i, k in enumerate((0, 300, 1200, 2499))]
    rows += [(200, base + base[:500]), (201, "x" * 1200), (202, "ab" * 150), (203, None), (204, ""), (205, text(150)), (None, shared[-1])]
    rows += [(300 + i, rows[3][1]) for i in range(5)] + [(400, rows[205 - 140][1]), (400, rows[205 - 140][1]), (401, "q" * 199), (402, "q" * 199)]
    return rows


def test_cover_makes_every_difference():
    assert {(a - b) % R.PERIOD for a in R.COVER for b in R.COVER} == set(range(R.PERIOD))


def test_against_brute_force(spark, monkeypatch):
    rows = fixture()
    frame = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, chunk string").repartition(3)
    key = lambda x: (x[0] is None, x[0] or 0, x[4])
    want = sorted(brute(rows), key=key)
    got = sorted(((*x[:4], bytes(x[4])) for x in R.remove_repeats(frame).collect()), key=key)
    assert got == want
    assert sum(x[2] > 0 for x in want) > 20


def test_many_chunks_and_ranges():
    rows = fixture()
    data = [(t or "").encode() for _, t in rows]
    import numpy as np

    parts = [data[k : k + 7] for k in range(0, len(data), 7)]
    none = np.zeros(0, np.int64)
    chunks = [R.Chunk(b"".join(p), np.array([len(x) for x in p]), none, none) for p in parts]
    import pandas as pd

    def settle(sents):
        rows = [(k, r, h) for k, s in enumerate(sents) for r, h in zip(*s.payloads(), strict=True)]
        frame = pd.DataFrame(rows, columns=["chunk", "range", "hashes"])
        out = [{} for _ in sents]
        for _, g in frame.groupby("range"):
            for c, r, m in R._twice(g).itertuples(index=False):
                out[c][r] = m
        return out

    m1 = settle([R._first(c, 5)[1] for c in chunks])
    second = [R._second(c, 3, m, 5) for c, m in zip(chunks, m1, strict=True)]
    m2 = settle([s for _, s in second])
    want = {}
    n = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    for k, (c, (at, s), m) in enumerate(zip(chunks, second, m2, strict=True)):
        found = set(at[s.answer(m)].tolist())
        want = {a + i for d, a in zip(parts[k], c.starts.tolist(), strict=True) for i in range(len(d) - 199) if n[d[i : i + 200]] > 1}
        assert found == want


def test_empty_table(spark):
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_within_and_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_BYTES", 3000)
    r = random.Random(2)
    hot = "".join(r.choice("abcdef ") for _ in range(450))
    rows = [(i, hot) for i in range(60)] + [(100 + i, "".join(r.choice("abcdef ") for _ in range(300))) for i in range(20)] + [(200, hot[:300]), (201, "short"), (202, "short")]
    got = sorted((*x[:4], bytes(x[4])) for x in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted(brute(rows))


def test_tables_are_dropped(spark):
    from terrasieve.llm import chunks

    out = R.remove_repeats(spark.createDataFrame(fixture(), "doc_id long, text string"))
    assert out.count() == len(fixture())
    chunks.drop_tables()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("terrasieve_chunks")]
