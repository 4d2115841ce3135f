import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from terrasieve.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(B.load_ranks(PATH)) if t}
    return tiktoken.Encoding("all", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(4)
    letters = "abcdefgh etaoin  .,'\n\t0123456789ABCéößñ日本語\u200d\U0001f600\U0001f468"
    out = ["".join(r.choice(letters) for _ in range(r.randrange(0, 400))) for _ in range(250)]
    out += ["", " ", "\n\n  \n", "don't I'LL we've", "<|endoftext|>", "a\x00b", "\u2028x", "the " * 300]
    # Runs around the length at which a row takes the way of long rows.
    for n in (1, 2, 3, B.LONG_ROW - 1, B.LONG_ROW, B.LONG_ROW + 1, 1000, 5001):
        out += ["a" * n, "ab" * n, "xyx" * n, "".join(r.choice("ab") for _ in range(n)), "=" * n, "é" * n, "".join(r.choice("etaoinshr") for _ in range(n))]
    return out


def check(row, text, library):
    ids = library.encode_ordinary(text)
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text[:60]
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_is_the_librarys(spark, library):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in B.round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        check(got[i], t, library)


def test_rows_of_every_kind(spark, library):
    rows = [(1, None, 5, "x"), (1, None, 5, "x"), (None, "the of", 1, "y"), (3, "ab", 2, None), (3, "ab", 2, None), (3, "other", 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = B.round_trip(df)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = got.collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    by = sorted((str(r.doc_id), r.ids_sha256) for r in found)
    want = [(str(i), hashlib.sha256(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest()) for i, t, *_ in rows]
    assert by == sorted(want)


def test_ids_decode_to_the_text(spark, library):
    rows = list(enumerate(texts()[:80])) + [(900, None)]
    encoded = B.encode(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r.ids == library.encode_ordinary(dict(rows)[r.doc_id] or "") for r in encoded.collect())
    assert all(bytes(r.bytes) == (dict(rows)[r.doc_id] or "").encode() for r in B.decode(encoded).collect())
    assert B.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().bytes == b""


def test_a_megabyte_in_one_piece(spark, library):
    r = random.Random(6)
    long = ["".join(r.choice("abcdefg") for _ in range(1_000_000)), "ab" * 500_000]
    rows = [(i, t + " the end") for i, t in enumerate(long)]
    for row in B.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        # The library takes minutes over such a piece; its ids decode to the text, and no pair of
        # neighbours is left to merge.
        assert row.decoded_sha256 == hashlib.sha256(rows[row.doc_id][1].encode()).hexdigest()
    model = B.model(PATH)
    ids = np.frombuffer(next(iter(B.TextEncoder(PATH, public_tokenizers.PATTERN).encode([long[0]]))), "<u4").astype(np.int32)
    assert (model.pairs.lookup(ids[:-1], ids[1:]) == B.NONE).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.round_trip(df).count() == 0 and B.decode(B.encode(df)).count() == 0


def test_large_ids_beside_a_null(spark):
    ids = [2**53 + 1, None, -(2**53) - 1, 2**63 - 1]
    df = spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string").coalesce(1)
    assert sorted(str(r.doc_id) for r in B.round_trip(df).collect()) == sorted(map(str, ids))
    coded = B.encode(df)
    assert sorted(str(r.doc_id) for r in coded.collect()) == sorted(map(str, ids))
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in B.decode(coded).collect()) == sorted((str(i), b"some words") for i in ids)
