"""Importance resampling towards a target corpus, with hashed n-gram features (DSIR).

Features are runs of one to ``n`` words; a feature's bucket is the CRC-32 of its bytes. The CRC of
each word is computed once per worker and the CRCs of n-grams are composed from them: a CRC is
linear over GF(2), so crc(a + b) is crc(a) moved by the length of b, a 32 by 32 bit matrix, and
crc(b) on top. Matrices for lengths of powers of two come by squaring; those of short lengths are
held as byte tables. No n-gram is ever spelled out.

Counts per bucket of all documents and of the target make a gain for each bucket; a document's
weight is the mean gain of its features, and Gumbel noise from its id turns weights into a draw
without replacement: the highest scores win. Buckets are few and go to the driver. For the ranks,
equal rows are one row with a count, rows are counted by score (whole numbers of a bounded range:
the logarithm of a count has few values), and within a score by id.

Null text has no words, null ``doc_id`` stays, is drawn for as the empty id and comes last among
equal scores. Repeated rows are documents of their own with the same score, ranked one after the
other. Rows that tie in score and id are ordered by their number of features. Other columns are
ignored (``sample`` keeps them, whatever their names). An empty table gives an empty result, an
empty target gains from its missing counts alone. Texts are taken whole, words of any length.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialise, row_rank, texts

#: Runs of digits, letters and everything beyond ASCII, in bytes of lower-cased UTF-8.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Reversed polynomial of CRC-32, a fixed value.
POLYNOMIAL = 0xEDB88320
SPACE = zlib.crc32(b" ")
#: Lengths below this have a matrix of their own.
SHORT = 64
#: Words looked at together, words that a worker remembers, copies of a row that a task spells out.
SLICE_WORDS, KNOWN_WORDS, BLOCK = 400_000, 1_000_000, 100_000


def _one_byte(crc: np.ndarray) -> np.ndarray:
    """CRCs moved by a byte, bit by bit."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ np.where(crc & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return crc


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A matrix, given as the images of each value of the four bytes, times vectors."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@functools.cache
def _matrices() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables of the shifts by 0 to SHORT - 1 bytes, and by SHORT, 2 * SHORT, ... bytes."""
    own = np.arange(256, dtype=np.uint32)
    now = np.stack([own << np.uint32(8 * k) for k in range(4)])
    short = []
    for _ in range(SHORT):
        short.append(now)
        now = _one_byte(now)
    squares = []
    for _ in range(32):
        squares.append(now)
        now = _apply(now, now)  # the matrix times itself
    return np.stack(short), np.stack(squares)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved by so many bytes each."""
    short, squares = _matrices()
    n = length % SHORT
    crc = short[n, 0, crc & 255] ^ short[n, 1, crc >> 8 & 255] ^ short[n, 2, crc >> 16 & 255] ^ short[n, 3, crc >> 24]
    rest, k = length // SHORT, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        crc[odd] = _apply(squares[k], crc[odd])
        rest, k = rest >> 1, k + 1
    return crc


class Known(dict):
    """CRC and length of words, in one integer; each word is computed once."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = zlib.crc32(word) | len(word) << 32
        return value


def features(rows: list[str], known: Known, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: words of each text, buckets of all features, and the text of each
    feature (a number within the slice)."""
    at = 0
    while at < len(rows):
        found, size = [], 0
        while at < len(rows) and size < SLICE_WORDS:
            found.append(WORDS.findall(rows[at].encode("utf-8", "surrogatepass").lower()))
            size += len(found[-1])
            at += 1
        if len(known) > KNOWN_WORDS:
            known.clear()
        counts = np.array([len(w) for w in found], np.int64)
        packed = np.fromiter((known[w] for some in found for w in some), np.int64, size)
        crc, length = (packed & 0xFFFFFFFF).astype(np.uint32), packed >> 32
        text = np.repeat(np.arange(len(found)), counts)
        out, owner, gram = [crc % np.uint32(buckets)], [text], crc
        for k in range(1, n):
            # gram[i] ends before word i + k; it goes on with a space and this word.
            gram = shifted(shifted(gram[:-1], np.ones(max(0, len(gram) - 1), np.int64)) ^ np.uint32(SPACE), length[k:]) ^ crc[k:]
            same = text[k:] == text[: len(text) - k]
            out.append(gram[same] % np.uint32(buckets))
            owner.append(text[k:][same])
        yield counts, np.concatenate(out), np.concatenate(owner)


def bucket_counts(docs: DataFrame, n: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = Known(), np.zeros(buckets, np.int64)
        for b in batches:
            for _, at, _ in features(b.column(0).to_pylist(), known, n, buckets):
                sums += np.bincount(at, minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["bucket", "n"])

    held = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in held.collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket is worth: 1000 times the logarithm of how much likelier it
    is in the target, rounded down; counts are smoothed by one."""
    own, wanted = bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets)
    a, b = int(own.sum()) + buckets, int(wanted.sum()) + buckets
    return np.array([math.floor(1000 * math.log(((t + 1) * a) / ((s + 1) * b))) for s, t in zip(own.tolist(), wanted.tolist(), strict=True)], np.int64)


def _noise(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gain: np.ndarray, n: int = 2, seed: int = SEED) -> DataFrame:
    """``docs (doc_id, text, ...)`` without the text, with ``n_words``, ``n_features``, ``weight``
    and ``score``."""
    text, rest = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in batches:
            words, n_features, weight = [], [], []
            for counts, at, owner in features(b.column(text).to_pylist(), known, n, len(gain)):
                size = np.bincount(owner, minlength=len(counts))
                # Whole numbers up to 2^53 are summed exactly.
                total = np.bincount(owner, gain[at], len(counts)).astype(np.int64)
                words.append(counts), n_features.append(size), weight.append(total // np.maximum(size, 1))
            held = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in (words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns) if i != text], *held], names=[*rest, "n_words", "n_features", "weight"])

    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType([*kept, *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]])
    return docs.mapInArrow(run, schema).withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def _groups(rows: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``doc_id, n_features, weight, score, n, start, drawn``: equal rows once with their number,
    how many rows come before them (null if they don't take part) and how many are drawn."""
    keys = ["doc_id", "n_features", "weight", "score"]
    held = materialise(rows.groupBy(*keys, (F.col("n_words") >= least_words).alias("long")).agg(F.count("*").alias("n")), "weights")
    by_score = held.where("long").groupBy("score").agg(F.sum("n").alias("m"))
    # Scores are whole numbers between bounds that the logarithms of counts set.
    earlier = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    by_score = by_score.select(F.col("score").alias("__score"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    total = held.where("long").agg(F.sum("n")).first()[0] or 0
    quota = percent * total // 100
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features").rowsBetween(Window.unboundedPreceding, -1)
    ranked = held.where("long").join(F.broadcast(by_score), F.col("score") == F.col("__score")).where(F.col("before") < quota)
    ranked = ranked.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    ranked = ranked.select(*keys, "n", "start", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(quota) - F.col("start"))).alias("drawn"))
    low = held.where("long").join(F.broadcast(by_score), F.col("score") == F.col("__score")).where(F.col("before") >= quota)
    rest = low.select(*keys, "n").unionByName(held.where("not long").select(*keys, "n"))
    return ranked.unionByName(rest.select("*", F.lit(None).cast("long").alias("start"), F.lit(0).cast("long").alias("drawn")))


def resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document: of those with enough words
    the given share is drawn and ranked from 1; ``rank`` of the others is null."""
    rows = weighted(texts(docs), gains(docs, target, n, buckets), n, seed)
    every = _groups(rows, least_words, percent)
    # A row with very many copies is spelled out by many tasks.
    every = every.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))).repartition("doc_id", "part")
    last = F.least(F.col("n"), (F.col("part") + 1) * BLOCK) - 1
    every = every.withColumn("k", F.explode(F.sequence(F.col("part") * BLOCK, last)))
    rank = F.when(F.col("k") < F.col("drawn"), F.col("start") + F.col("k") + 1)
    return every.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def sample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns. Of rows that tie in id and features at
    the end of the draw, those with the least hash of all columns are in."""
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__all"), row_rank(docs).alias("__rank"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialise(weighted(own, gains(docs, target, n, buckets), n, seed).where(F.col("n_words") >= least_words), "weighted")
    drawn = _groups(rows, least_words, percent).where("drawn > 0")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("doc_id", "n_features", "weight")]
    held = rows.join(drawn.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "n_features", "weight")], "n", "drawn"), same)
    whole = held.where(F.col("n") == F.col("drawn")).select("__all")
    part = held.where(F.col("n") > F.col("drawn"))  # the copies of one row, where the draw ends
    left = part.select("drawn").first()
    if left is not None:
        whole = whole.unionByName(part.orderBy("__rank").limit(left.drawn).select("__all"))
    return whole.select(*[F.col("__all").getField(c).alias(c) for c in docs.columns])
