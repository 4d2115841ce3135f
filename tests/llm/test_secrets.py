import hashlib
import math
import random
import re
from collections import Counter

from terrasieve.llm import secrets as S

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    added = []
    for m in re.finditer(S.CANDIDATE, text):
        if any(b[0] < m.end() and m.start() < b[2] for b in out) or any(re.search(a, m[0]) for a in S.ALLOW):
            continue
        limit = next(b for p, b in S.CLASSES if re.search(p, m[0]))
        w = S.WINDOW
        high = [i for i in range(len(m[0]) - w + 1) if -sum(n / w * math.log2(n / w) for n in Counter(m[0][i : i + w]).values()) >= limit - 1e-9]
        if high:
            added.append((m.start() + high[0], 3, m.start() + high[-1] + w))
    return out, added


def told(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def fixture():
    r = random.Random(5)
    rows = [(0, None), (1, ""), (2, "x" * 30000 + " password = 'hunter22' é AKIA" + "A" * 16), (2, "Token:abc, secret=token: abcdefgh API_KEY==abcde"), (None, "aKIA AKIAAKIA" + "Z" * 12 + "deadbeef" * 4)]
    rows += [(10, "ĂĄ paſsword=abcdefg passwd:\"x.y=z+1\" " + "0123456789abcdef" * 3 + "g" + "a" * 23), (11, "see 123e4567-e89b-12d3-a456-426614174000 and path/to/some-long_name/2024/05/06")]
    for i in range(20, 80):
        n = r.randrange(15, 70)
        alphabet = r.choice(["0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ab1"])
        rows.append((i, "é " * r.randrange(3) + "the key " + "".join(r.choice(alphabet) for _ in range(n)) + r.choice([" ok", "==", "\n"]) + "token=" * r.randrange(2) + "abc" * r.randrange(4)))
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    got = S.report(spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, spans string")).collect()
    want = []
    for i, t in rows:
        base, added = brute(t)
        kinds = Counter(k for _, k, _ in base)
        want.append((i, kinds[0], kinds[1], kinds[2], hashlib.sha256(told(base).encode()).hexdigest(), told(base + added), len(added)))
    key = lambda x: (x[0] is None, x[0] or 0, x[5])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(w[6] for w in want) >= 10


def test_redact(spark):
    rows = fixture()
    got = S.redact(spark.createDataFrame([(a, b, 7, len(b or "")) for a, b in rows], "doc_id long, text string, base int, n_chars long"))
    assert got.columns == ["doc_id", "text", "base", "n_chars"]
    want = []
    for i, t in rows:
        at, out = 0, ""
        spans = sorted(sum(brute(t), []))
        for a, _, b in spans:
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, b)
        new = out + t[at:] if spans else t
        want.append((i, new, 7, len(new or "")))
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert S.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_beside(text):
    base, added = brute(text)[0], []
    for m in re.finditer(S.CANDIDATE, text or ""):
        free = [all(not a <= i < b for a, _, b in base) for i in range(m.start(), m.end())]
        for run in re.finditer("1+", "".join("01"[f] for f in free)):
            at, piece = m.start() + run.start(), m[0][run.start() : run.end()]
            if len(piece) < S.WINDOW or any(re.search(a, piece) for a in S.ALLOW):
                continue
            limit, w = next(b for p, b in S.CLASSES if re.search(p, piece)), S.WINDOW
            high = [i for i in range(len(piece) - w + 1) if -sum(n / w * math.log2(n / w) for n in Counter(piece[i : i + w]).values()) >= limit - 1e-9]
            if high:
                added.append((at + high[0], 3, at + high[-1] + w))
    return base, added


def test_secrets_beside_base_spans(spark, tmp_path):
    r = random.Random(8)
    key = lambda n, more="+": "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more) for _ in range(n))
    access, run, letters = "AKIA" + "Q7" * 8, "0f3a" * 8, "qWkZrTbVxLpNmGhJcDyFsAeU"
    k = [key(40) for _ in range(6)]
    rows = [(1, f"é {access}/{k[0]} x"), (2, f"{k[1]}={access}={k[2]}"), (3, f"{run}-{k[3]}"), (4, f"{k[4]}=/token=abcdefgh {access}/short"), (5, f"{k[5]}_{run}/{run}_word"), (6, f"see {letters} and +some/long_path/ofWordsAndNames/x/"), (7, "ab/cd/" * 40 + "x1y2" * 5 + " " + "ab" * 40 + "1c2")]
    rows += [(i + 100, t) for i, t in fixture() if i is not None]
    import __spark_entry__

    spark.createDataFrame([(a, b, "s", len(b or "")) for a, b in rows], "doc_id long, text string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.doc_id, x.spans) for x in __spark_entry__.queries()["op4_secret_spans"](spark, str(tmp_path)).collect()}
    assert got == {(i, told(sum(brute_beside(t), []))) for i, t in rows}
    import corpus_pipeline

    clean = {x.doc_id: x.text for x in corpus_pipeline.redact_secrets(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    for i, secret in zip((1, 2, 2, 3, 4, 5), k, strict=True):
        assert secret[8:-8] not in clean[i]
    assert letters not in clean[6] and "+some/long_path/ofWordsAndNames/x/" in clean[6]


def test_a_candidate_of_a_megabyte_and_very_many_spans(spark):
    import time

    r = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    image = "data:x;base64," + "".join(r.choice(alphabet) for _ in range(1_000_000)) + "=="
    many = " ".join(f"token={r.randrange(10**9):09d}x" for _ in range(5000))
    rows = [(1, image), (2, many), (3, "aab" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {x.doc_id: x.spans for x in S.report(df).collect()}
    assert time.time() - began < 30
    for i, t in rows[1:]:
        assert got[i] == told(sum(brute(t), []))
    assert got[1] == f"entropy:14:{14 + 1_000_002}" or told(sum(brute(image), [])) == got[1]
    clean = {x.doc_id: x.text for x in S.redact(df).collect()}
    assert clean[2] == " ".join(["[secret]"] * 5000) and len(clean[1]) < 100
