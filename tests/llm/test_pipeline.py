import hashlib
import random
import re
from collections import Counter

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from terrasieve.llm import bpe, toxicity
from test_simhash import brute_components, brute_fp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(8)
    vocab = ["".join(r.choice(["ta", "ro", "li", "en", "shu", "é"]) for _ in range(r.randrange(1, 5))) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        w = [r.choice(vocab) for _ in range(r.randrange(5, 80))]
        toxic = int(i % 5 == 0)
        if toxic:
            w[0:0] = ["blarg", "snerk", "you", "blarg"]
        if i % 17 == 3:
            w.insert(2, "password=Zx9Kq2Lm8Pv4")
        text = " ".join(w)
        docs.append((i, text, "en", ["web", "web", "web", "books", None][i % 5 if i > 40 else 0], len(text)))
        labels.append((i, 1, toxic))
        if i % 10 == 1:  # copies, exact and near
            docs.append((1000 + i, text, "en", "web", len(text)))
            docs.append((2000 + i, text.upper().replace("PASSWORD=ZX9KQ2LM8PV4", "password=Zx9Kq2Lm8Pv4"), None, "books", len(text)))
    docs += [(5000, None, None, None, None), (5001, "", "en", "web", 0), (None, "the of and", "en", "web", 10), (7, docs[8][1], "en", "web", 3)]
    docs.append((6000, "word " * 100_000, "en", "web", 500_000))
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to, (docs, labels) = tmp_path_factory.mktemp("sf"), corpus()
    extra = COLUMNS + ", __score double, __key int, fp int, epoch string"
    spark.createDataFrame([(*d, 0.5, 1, 2, "x") for d in docs], extra).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return str(to)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = rows(docs), docs.columns
    stages = dict(C.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "secret_scan", "source_mixing", "bpe_round_trip"]

    def run(name, df):
        out = spark.createDataFrame(stages[name](spark, df, folder).collect(), df.schema)
        assert out.columns == columns
        return out

    # Toxicity: rows that the model scores below one half, scored here one by one.
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = run("toxicity", docs)
    want = [r for r in before if model.score([r[1] or ""])[0] < 0.5]
    assert Counter(rows(clean)) == Counter(want)
    gone = {r[0] for r in before} - {r[0] for r in want}
    toxic = {i for i, _, y in corpus()[1] if y}
    assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) < 8

    # Near-duplicates: of each component the row of least id (then of any one text).
    one = run("simhash_near_dedup", clean)
    known = [r for r in want if r[0] is not None]
    fps = {k: brute_fp(r[1]) for k, r in enumerate(known)}
    component = brute_components(fps)
    least = {}
    for k, r in enumerate(known):
        least.setdefault(component[k], []).append(r[0])
    got = [r for r in rows(one) if r[0] is not None]
    assert len(got) == len(least) and sorted(r[0] for r in got) == sorted(map(min, least.values()))
    assert set(got) <= set(known) and len([r for r in rows(one) if r[0] is None]) == len([r for r in want if r[0] is None])

    # Secrets: the base patterns are gone, rows without secrets are as they were.
    scanned = run("secret_scan", one)
    was = {r[0]: r for r in rows(one)}
    for r in rows(scanned):
        old = was[r[0]]
        if "password=" in (old[1] or ""):
            assert "Zx9Kq2Lm8Pv4" not in r[1] and "[secret]" in r[1] and r[4] == len(r[1])
        else:
            assert r == old
    assert len(rows(scanned)) == len(was)

    # Mixing: every row stays, all columns as they were, small sources are repeated.
    mixed = run("source_mixing", scanned)
    times = Counter(rows(mixed))
    assert set(times) == set(rows(scanned))
    by = {s: [n for r, n in times.items() if r[3] == s and re.search(r"[^ ]", r[1] or "")] for s in {r[3] for r in times}}
    assert np.mean(by["books"]) > np.mean(by["web"]) and all(n <= 4 for n in times.values())

    # Encoding: the library's ids, and the bytes of the text again.
    out = stages["bpe_round_trip"](spark, mixed, folder).collect()
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))) if t}
    library = tiktoken.Encoding("all", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def digests(text):
        ids = library.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    known = {t: digests(t) for t in {r[1] for r in rows(mixed)}}
    assert Counter(map(tuple, out)) == Counter((r[0], *known[r[1]]) for r in rows(mixed))


def test_run_is_the_stages_in_order(spark, folder):
    found = C.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        held = docs.schema
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), held)
    want = C.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_no_row_of_large_id_is_lost(spark, tmp_path):
    r = random.Random(3)
    ids = [2**53 + 1 + 2 * k for k in range(40)] + [None]
    docs = [(i, " ".join(f"w{r.randrange(9999)}" for _ in range(40)), "en", "web", 1) for i in ids]
    spark.createDataFrame(docs, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted({str(x.doc_id) for x in C.run(spark, str(tmp_path)).collect()}) == sorted(map(str, ids))
