import random
import re
from collections import Counter

from terrasieve.llm import quality as Q


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {k for k, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def rows(n=900):
    r = random.Random(9)
    vocab = [f"w{i}é" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(3, 160))]
        bad = r.random() < 0.25
        if bad and i % 2:
            w = [x + r.choice(["###", "***", "$"]) for x in w]
        elif bad:
            w = [x.upper() + "!!" for x in w]
        if r.random() < 0.2:
            k = r.randrange(len(w))
            w[k:k] = w[k : k + r.randrange(5, 20)] * r.randrange(1, 4)
        docs.append((i, " ".join(w).replace(" ", "\n", r.randrange(3)) + r.choice(["", "\nsame line\n \nsame line"])))
        labels.append((i, int(not bad), 0))
    docs += [(2000, None), (2001, ""), (2002, "x" * 50000), (None, "a b"), (4, docs[4][1]), (2003, "k " * 30000)]
    return docs, labels + [(None, 0, 0), (7777, 0, 0), (5, None, 0)]


def test_against_brute_force_and_labels(spark):
    docs, labels = rows()
    frame = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_words int")
    got = Q.judge(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    want = Counter((i, *brute(t)) for i, t in docs)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    truth = {i: q for i, q, _ in labels}
    right = 0
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)
        right += r.doc_id in truth and (r.rule == 0) == (truth[r.doc_id] == 1)
    assert right / 900 > 0.97


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "w " * 8 + "x")], "doc_id long, text string")
    assert [(r.kept, r.rule) for r in Q.judge(docs, none).collect()] == [(False, 0)]
    assert Q.judge(docs.limit(0), none).count() == 0
