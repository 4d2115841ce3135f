import random

import numpy as np
import pytest
from terrasieve.llm import toxicity as T


def auc(y, s):
    order = np.argsort(s)
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(1)
    vocab = ["".join(r.choice(["ta", "ro", "li", "en", "shu"]) for _ in range(r.randrange(1, 5))) for _ in range(400)]
    docs, labels = [], []
    for i in range(1500):
        w = [r.choice(vocab) for _ in range(r.randrange(5, 120))]
        y = int(r.random() < 0.2)
        if y:
            for _ in range(r.randrange(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(["blarg", "Snerk!", "you blarg", "quxo" + r.choice(vocab)]))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, 1, y))
    docs += [(5000, None, "x"), (5001, "", "x"), (None, "you blarg blarg", "x"), (7, docs[7][1], "x")]
    labels += [(None, 1, 1), (6000, 1, 1), (3, 1, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, y) for i, _, y in labels)


def test_held_out_accuracy(planted):
    docs, labels, truth = planted
    model = T.fit(docs, labels)
    rows = T.score(docs, model).collect()
    assert len(rows) == docs.count()
    import zlib

    held = [r for r in rows if r.doc_id is not None and r.doc_id < 1500 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    y, s = np.array([truth[r.doc_id] for r in held]), np.array([r.score for r in held])
    assert auc(y, s) > 0.97
    assert ((s >= 0.5) == y).mean() > 0.95
    by = {r.doc_id: r.score for r in rows}
    assert by[5000] == by[5001] < 0.5 and by[None] > 0.5
    kept = T.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.score < 0.5)


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-s))).astype(float)
    xs, ys = T.fit_isotonic(s, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all() and 0 < ys[0] and ys[-1] < 1


def test_obfuscation_is_undone():
    lex = T.Lexicon({"blarg": 5.0}, {})
    f = dict(zip(T.FEATURES, T.features("you bl4rg b*larg fine", lex), strict=True))
    assert f["mixed_hits"] == 2 and f["mixed_rate"] == 0.5


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in T.score(docs, T.fit(docs, none)).collect()] == [0.0]
    assert T.score(docs.limit(0), T.fit(docs.limit(0), none)).count() == 0


def plain_features(text, lex):
    """The features as their names say, word by word."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return dict.fromkeys(T.FEATURES, 0.0)
    bare = [w.strip(T.EDGE) for w in words]
    stem = [max((lex.stems[s] for s in (b[:4], b[:5], b[:6]) if s in lex.stems and len(b) > len(s)), default=None) for b in bare]
    hit = [b in lex.words or s is not None for b, s in zip(bare, stem, strict=True)]
    you = [b in T.SECOND_PERSON for b in bare]
    near = max([1 / (1 + abs(i - k)) for i in range(n) for k in range(n) if hit[i] and you[k] and abs(i - k) <= 5], default=0.0)
    raw = text.encode()
    letters = max(1, sum(c < 128 and chr(c).isalpha() for c in raw))
    odd = [bool(T.MIXED.search(b)) for b in bare]
    in_words = {w: lex.words[b] for w, b in zip(words, bare, strict=True) if b in lex.words}
    in_stems = {w: s for w, s in zip(words, stem, strict=True) if s is not None}
    return {
        "word_hits": sum(b in lex.words for b in bare),
        "word_density": sum(b in lex.words for b in bare) / n,
        "word_weight": sum(in_words.values()),
        "word_top": max(in_words.values(), default=0.0),
        "stem_hits": sum(s is not None for s in stem),
        "stem_density": sum(s is not None for s in stem) / n,
        "stem_weight": sum(in_stems.values()),
        "stem_top": max(in_stems.values(), default=0.0),
        "near_you": near,
        "you_density": sum(you) / n,
        "capitals": sum(65 <= c <= 90 for c in raw) / letters,
        "shouted": sum(c in b"!?" for c in raw) / n,
        "punctuation": sum(33 <= c < 48 or 58 <= c < 65 for c in raw) / len(raw),
        "symbols": sum(c in b"#$%&*<>|" for c in raw) / len(raw),
        "mixed_rate": sum(odd) / n,
        "mixed_hits": sum(b.translate(T.UNDO) in lex.words for b, o in {w: (b, o) for w, b, o in zip(words, bare, odd, strict=True)}.values() if o),
        "log_words": np.log1p(n),
    }


def test_features_word_by_word():
    r = random.Random(2)
    lex = T.Lexicon({"blarg": 5.0, "snerk": 4.0, "you": 3.5}, {"quxo": 4.5, "quxor": 6.0, "snerk": 3.0})
    pool = ["blarg", "Blarg!", "snerking", "QUXORIA", "quxo", "you", "Dich", "fine", "b1arg", "sn*rk", "a#b", "<x>", "ÄRGER", "12", "--", "you?"]
    for _ in range(300):
        text = "  ".join(r.choice(pool) for _ in range(r.randrange(0, 25)))
        got, want = dict(zip(T.FEATURES, T.features(text, lex), strict=True)), plain_features(text, lex)
        assert got == pytest.approx(want), text


def test_trees_and_calibration_row_by_row(planted):
    docs, labels, _ = planted
    model = T.fit(docs, labels)
    rows = [t or "" for (t,) in docs.select("text").limit(200).collect()]
    for text, got in zip(rows, model.score(rows), strict=True):
        x, t = T.features(text, model.lexicon), model.trees
        raw = t.base
        for f, c, leaf in zip(t.feature, t.cut, t.leaf, strict=True):
            node = 0
            while node < 2**T.DEPTH - 1:
                b = sum(e < x[f[node]] for e in t.edges[f[node]])
                node = 2 * node + (2 if b > c[node] else 1)
            raw += leaf[node - (2**T.DEPTH - 1)]
        want = 0.98 * np.interp(raw, *model.knots) + 0.02 / (1 + np.exp(-raw))
        assert got == pytest.approx(min(max(want, 0.0), 1.0))


def test_query_columns(spark, planted, tmp_path):
    import zlib

    from terrasieve.llm.queries import op8_toxicity_scores

    docs, labels, _ = planted
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for r in op8_toxicity_scores(spark, str(tmp_path)).collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_long_texts_and_clashing_columns(spark, planted):
    docs, labels, _ = planted
    model = T.fit(docs, labels)
    df = spark.createDataFrame([(1, "fine " * 300_000, 1.0, 2.0), (2, "you blarg snerk", None, 3.0)], "doc_id long, text string, __score double, __score_ double")
    assert [(r.doc_id, r["__score_"]) for r in T.keep_clean(df, model).collect()] == [(1, 2.0)]


def test_large_ids_and_repeated_labelled_rows(spark, planted):
    docs, labels, _ = planted
    ids = [2**53 + 1, None, 2**63 - 1]
    model = T.fit(docs, labels)
    df = spark.createDataFrame([(i, "you blarg snerk") for i in ids], "doc_id long, text string").coalesce(1)
    assert sorted(str(r.doc_id) for r in T.score(df, model).collect()) == sorted(map(str, ids))
    assert sorted(str(r.doc_id) for r in T.keep_clean(df.withColumn("text", T.F.lit("fine")), model).collect()) == sorted(map(str, ids))
    # Repeated rows of one id are learned from once.
    many = docs.unionByName(docs.where("doc_id < 20").crossJoin(spark.range(30).select("id")).drop("id"))
    again = T.fit(many, labels)
    assert (again.trees.leaf == model.trees.leaf).all() and again.knots[0].tolist() == model.knots[0].tolist()
