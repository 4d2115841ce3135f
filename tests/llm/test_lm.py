import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from terrasieve.llm import attention as A
from terrasieve.llm import lm as L

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(rows):
    crc = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10
    c = Counter(w for i, t in rows if crc(i) not in (None, 0) for w in [*split(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = [*split(t), None]
        out.append((i, crc(i) == 0, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out


def fixture():
    r = random.Random(3)
    syllables = [a + b for a in ("t", "r", "sh", "ö", "k", "m") for b in ("a", "en", "i", "ou")]
    frequent = ["the", "of", "and", "The"]
    rows = []
    for i in range(400):
        w = [r.choice(frequent) if r.random() < 0.5 else "".join(r.choice(syllables) for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(0, 150))]
        rows.append((i, "  ".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, "日本語  x \U0001f600"), (None, "the of"), (7, rows[7][1]), (1003, "y" * 5000 + " the")]


def test_base_is_exact_and_model_learns(spark):
    rows = fixture()
    got = L.score(spark.createDataFrame([(a, b, 1.0) for a, b in rows], "doc_id long, text string, score double").repartition(3)).collect()
    key = lambda x: (str(x[0]), x[2], round(x[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(brute_base(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6
        assert math.isfinite(g[6]) and g[6] < 0
    # Held-out texts are likelier than under the counts of subword ids alone.
    sub = L.Subwords(PATH)
    ids = {i: np.append(sub.encode([w.encode() for w in split(t)])[0], A.IDS) for i, t in rows}
    learn = [i for i in ids if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = np.bincount(np.concatenate([ids[i] for i in learn]), minlength=A.IDS + 1) + 0.5
    flat = {i: float(np.log10(c[x] / c.sum()).sum()) for i, x in ids.items()}
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > 0.75 * sum(flat[g[0]] for g in held)


def model():
    rng = np.random.default_rng(1)
    counts, opens = rng.integers(0, 50, A.IDS + 1), rng.random(A.IDS + 1) < 0.4
    place, n = A.slots(counts, opens)
    return A.views(A.start_weights(counts, place), A.n_classes(place)), place, n, opens


def test_probabilities_sum_to_one():
    w, place, n, opens = model()
    given = np.random.default_rng(2).integers(0, A.IDS, (1, A.WIDTH)).astype(np.int32)
    total = opened = 0.0
    for i in range(A.IDS + 1):
        target = np.full((1, A.WIDTH), -1, np.int32)
        target[0, 9] = i
        p, o, _, _ = A.log_probabilities(w, place, n, given, target, np.zeros(1, int))
        total += math.exp(p[0])
        opened += math.exp(p[0]) * opens[i]
    assert abs(total - 1) < 1e-3 and abs(opened - math.exp(o[0])) < 1e-3


def test_windows_score_each_id_once_and_look_back_only():
    rng = np.random.default_rng(5)
    lengths = np.array([1, 5, A.WIDTH, A.WIDTH + 1, 200])
    ids = rng.integers(0, A.IDS, lengths.sum()).astype(np.int32)
    given, target, first, doc, start = L.windows(ids, lengths)
    seen = np.zeros(len(ids), int)
    for k in range(len(given)):
        for c in range(first[k], A.WIDTH):
            if target[k, c] >= 0:
                assert target[k, c] == ids[start[k] + c]
                seen[start[k] + c] += 1
    assert (seen == 1).all()
    w, place, n, _ = model()
    other = given.copy()
    other[:, 20:] = 3
    a, b = (A.log_probabilities(w, place, n, g, target, first) for g in (given, other))
    early = a[3] < 20
    assert np.allclose(a[0][early], b[0][early], atol=1e-4)


def test_gradients():
    w, place, _, _ = model()
    w = {k: v.astype(np.float64) for k, v in w.items()}
    g, other = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    rng = np.random.default_rng(4)
    given = rng.integers(0, A.IDS, (2, A.WIDTH)).astype(np.int32)
    target = np.where(rng.random((2, A.WIDTH)) < 0.8, rng.integers(0, A.IDS, (2, A.WIDTH)), -1).astype(np.int32)
    A.gradients(w, place, given, target, g)
    for k in w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w[k][at] += 1e-5
        up = A.gradients(w, place, given, target, other)
        w[k][at] -= 2e-5
        down = A.gradients(w, place, given, target, other)
        w[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3 * abs(g[k][at]) + 1e-6, k


def test_exponential_of_scores():
    x = np.concatenate([np.linspace(-85, 85, 100_001), [0.0]]).astype(np.float32)
    want, got = np.exp(x.astype(np.float64)), x.copy()
    A._exp(got)
    assert np.abs(got / want - 1).max() < 3e-4


def test_subwords_match_words():
    sub = L.Subwords(PATH)
    ids, edge = sub.encode([b"the", "été".encode(), b"zzzqq", "日".encode()])
    back = [sub.encoding.decode_bytes(ids[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    assert back == [b" the", " été".encode(), b" zzzqq", " 日".encode()]


def test_empty_table(spark):
    assert L.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_training_id_is_a_target_once():
    rows = [(i, "the of and " * (3 * i)) for i in range(60)] + [(None, "the " * 90)]
    text = L.Text([i for i, _ in rows], [t.encode() for _, t in rows])
    sub = L.Subwords(PATH)
    ids, lengths, counts = text.subwords(sub)
    whole = [np.append(sub.encode([w.encode() for w in split(t)])[0], A.IDS) for _, t in rows]
    assert ids.tolist() == np.concatenate(whole).tolist() and lengths.tolist() == [len(x) for x in whole]
    learn = np.array([i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows])
    assert text.train.tolist() == learn.tolist()
    own = np.concatenate([x for x, y in zip(whole, learn, strict=True) if y])
    assert counts.tolist() == np.bincount(own, minlength=A.IDS + 1).tolist()
    dealt = [L.round_windows(ids, lengths, learn, r) for r in range(L.ROUNDS)]
    targets = np.concatenate([t.ravel() for _, t in dealt])
    assert np.bincount(targets[targets >= 0], minlength=A.IDS + 1).tolist() == counts.tolist()
    sizes = [len(g) for g, _ in dealt]
    assert max(sizes) - min(sizes) <= 1
    for given, target in dealt:  # the input at a place is the target before it
        both = (target[:, 1:] >= 0) & (target[:, :-1] >= 0)
        assert (given[:, 1:][both] == target[:, :-1][both]).all()


def test_words_of_a_chunk():
    raw = ["The  öö\tthe\nx", "", " \r\n", "x y\x0bThe Ä", "x" * 300_000].copy()
    text = L.Text(list(range(5)), [t.encode() for t in raw])
    assert text.lengths.tolist() == [len(split(t)) for t in raw]
    assert [text.words[i].decode() for i in text.number] == [w for t in raw for w in split(t)]
    assert len(set(text.words)) == len(text.words)


def test_sums_in_a_tree(spark):
    import pandas as pd

    parts = spark.createDataFrame([(i, i) for i in range(3000)], "g long, n long").repartition(7)
    out = L._tree(parts, 3000, lambda some: pd.DataFrame({"g": some["g"].iloc[:1], "n": [some["n"].sum()]}), "n long")
    assert len(out) <= L.FAN_IN and sum(r.n for r in out) == 2999 * 1500


def test_score_is_the_networks_alone(spark):
    n = 60
    rows = [(i, "the of " * n) for i in range(300)] + [(None, "the the " * n)]
    got = L.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # The network knows the order of words, which the base score cannot: held-out texts are likelier.
    held = [r for r in got if r.held_out]
    assert held and all(r.score > 0.5 * r.base_score for r in held)
    # A mixture with the word's share could fall by log10(2) a word below the base score at most.
    odd = next(r for r in got if r.doc_id is None)
    assert odd.score < odd.base_score - odd.n_tokens * math.log10(2)


def test_network_alone_beats_unigrams_of_words_on_held_out_text(spark):
    got = L.score(spark.createDataFrame(fixture(), "doc_id long, text string")).where("held_out and n_known = n_tokens").collect()
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_ranks_are_the_most_frequent_pairs():
    counts = {w: n for n, w in enumerate([b"abab", b"aab", "é".encode(), b"ab", b"x", b"zz"], L.LEAST_SEEN)}
    parts, ranks = {w: [bytes([b]) for b in b" " + w] for w in counts}, {bytes([b]): b for b in range(256)}
    while True:
        seen = Counter()
        for w, p in parts.items():
            for pair in zip(p, p[1:]):
                seen[pair] += counts[w]
        pair = min(seen, key=lambda x: (-seen[x], x), default=None)
        if pair is None or seen[pair] < L.LEAST_SEEN:
            break
        ranks.setdefault(b"".join(pair), len(ranks))
        for w, p in parts.items():
            at = 0
            while at + 1 < len(p):
                if (p[at], p[at + 1]) == pair:
                    p[at : at + 2] = [b"".join(pair)]
                at += 1
    assert L.fit_ranks(counts) == ranks
    assert L.fit_ranks({b"once": L.LEAST_SEEN - 1}) == {bytes([b]): b for b in range(256)}


def test_learned_ranks_need_few_ids_and_lose_no_word():
    r = random.Random(5)
    syllables = [a + b for a in ("qux", "vlo", "zny", "wö") for b in ("ka", "wuj", "ybb")]
    words = ["".join(r.choice(syllables) for _ in range(3)) for _ in range(3000)]
    learned, public = L.Subwords(L.fit_ranks(Counter(w.encode() for w in words))), L.Subwords(PATH)
    fresh = ["".join(r.choice(syllables) for _ in range(3)).encode() for _ in range(500)] + ["日本".encode(), b"Q"]
    ids, edge = learned.encode(fresh)
    assert [learned.encoding.decode_bytes(ids[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:], strict=True)] == [b" " + w for w in fresh]
    assert len(ids) < 0.5 * len(public.encode(fresh)[0])


def test_three_short_rows_of_scores_cost_less_than_two_long_ones():
    counts, opens = np.arange(A.IDS + 1), np.arange(A.IDS + 1) % 5 > 0
    place, n = A.slots(counts, opens)
    widths = [A.shapes(A.n_classes(place))[k][-1] for k in ("G", "C", "U")]
    assert len(set(place.tolist())) == A.IDS + 1 and sum(widths) <= 52
    assert (place[opens] < n * A.FAN**2).all() and (place[~opens] >= n * A.FAN**2).all()


def test_a_task_is_one_replica(spark):
    text = L.Text(list(range(1, 41)), [b"the of and " * 40] * 40)
    sub = L.Subwords(PATH)
    ids, lengths, counts = text.subwords(sub)
    place, _ = A.slots(counts, np.append(sub.opens, True))
    now = A.start_weights(counts, place)
    row = {"subwords": ids.astype("<i2").tobytes(), "lengths": lengths.tobytes(), "learn": text.train.tobytes()}
    made = spark.createDataFrame([row] * 3, "subwords binary, lengths binary, learn binary").coalesce(1)
    (got,) = made.mapInPandas(L._replicas(now, place, A.RATE, 0), "g long, n long, w binary").collect()
    given, target = L.round_windows(ids, lengths, text.train, 0)
    want = A.take_steps(now, place, np.concatenate([given] * 3), np.concatenate([target] * 3), A.RATE, 100)
    assert got.n == 3 * len(given) and np.allclose(np.frombuffer(got.w, "<f4"), want, atol=1e-4)
