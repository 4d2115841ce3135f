"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of two learned lexicons (whole words, and word beginnings of 4 to 6
letters), how near a lexicon word stands to a second-person pronoun, rates of capitals, of
punctuation and of obfuscated words (letters mixed with digits or signs), and how many of those
read as lexicon words once undone. Lexicons, trees and calibration learn from three disjoint
parts of a sample of labelled rows, so that a rare word which the lexicon took from one text
does not look certain to the trees.

The sample is ``SAMPLE_ROWS`` labelled rows at most, taken by hash of ``doc_id``; this bound
holds what reaches the driver (ids, term counts above the least support, and feature rows).
Scores cover every row. ``labels``, ``lang``, ``source`` and ``doc_id`` are no inputs of a score.

Null text counts as empty and has a score like any other. Rows with a null ``doc_id`` are scored,
never learned from. Labels that are null, conflicting (the greatest counts) or of unknown rows
do no harm; without labels of both classes every score is the share of toxic labels (0 if there
are none). Repeated rows each give a row; an empty table gives an empty result. Columns besides
``doc_id`` and ``text`` are ignored (``keep_clean`` keeps them).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

SAMPLE_ROWS = 24_000
#: A term joins a lexicon if it stands in so many toxic texts of its part, and the log odds of
#: toxic against clean are at least so high.
LEAST_SUPPORT, LEAST_ODDS, LEXICON_TERMS = 3, 3.0, 4000
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 3, 0.2, 48, 8
#: Second-person pronouns of the languages at hand, fixed values.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer sie usted ustedes ti tus su vosotros".split())
EDGE = ".,;:!?\"'()[]{}<>«»¿¡…"
#: What writers put for letters, fixed values.
UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "_": None, "-": None, ".": None})
MIXED = re.compile(r"[^\W\d_][0-9@$*!_.\-]+[^\W\d_]")
FEATURES = ("word_hits", "word_density", "word_weight", "word_top", "stem_hits", "stem_density", "stem_weight", "stem_top", "near_you", "you_density", "capitals", "shouted", "punctuation", "symbols", "mixed_rate", "mixed_hits", "log_words")


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def _stems(word: str) -> list[str]:
    return [word[:k] for k in (4, 5, 6) if len(word) > k]


def text_terms(text: str) -> tuple[set[str], set[str]]:
    """Distinct words and word beginnings of a text."""
    own = {w.strip(EDGE) for w in set(text.lower().split())} - {""}
    return own, {s for w in own for s in _stems(w)}


def features(text: str, lex: Lexicon) -> list[float]:
    raw = text.lower().split()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    distinct = set(raw)
    bare = {w: w.strip(EDGE) for w in distinct}
    words, stems = lex.words, lex.stems
    weight_w = {w: words[b] for w, b in bare.items() if b in words}
    weight_s = {}
    for w, b in bare.items():
        for s in (b[:4], b[:5], b[:6]):
            if s in stems and len(b) > len(s):
                weight_s[w] = max(weight_s.get(w, 0.0), stems[s])
    raw_bytes = text.encode("utf-8", "surrogatepass")
    tally = np.bincount(np.frombuffer(raw_bytes, np.uint8), minlength=256)
    mixed = mixed_hits = 0
    if tally[48:58].sum() or tally[33] or tally[36] or tally[42] or tally[45] or tally[64] or tally[95] or tally[46]:
        odd = {w for w, b in bare.items() if MIXED.search(b)}
        if odd:
            mixed = sum(1 for w in raw if w in odd)
            mixed_hits = sum(1 for w in odd if bare[w].translate(UNDO) in words)
    hits = weight_w.keys() | weight_s.keys()
    near = 0.0
    if hits:
        at = [i for i, w in enumerate(raw) if w in hits]
        for i in at:
            for k in range(max(0, i - 5), min(n, i + 6)):
                if bare[raw[k]] in SECOND_PERSON:
                    near = max(near, 1.0 / (1 + abs(k - i)))
        counts = Counter(raw[i] for i in at)
    else:
        counts = Counter()
    you = sum(1 for w in raw if bare[w] in SECOND_PERSON) if any(b in SECOND_PERSON for b in bare.values()) else 0
    nw, ns = sum(c for w, c in counts.items() if w in weight_w), sum(c for w, c in counts.items() if w in weight_s)
    letters = max(1, int(tally[65:91].sum() + tally[97:123].sum()))
    return [
        float(nw),
        nw / n,
        sum(weight_w.values()),
        max(weight_w.values(), default=0.0),
        float(ns),
        ns / n,
        sum(weight_s.values()),
        max(weight_s.values(), default=0.0),
        near,
        you / n,
        float(tally[65:91].sum()) / letters,
        float(tally[33] + tally[63]) / n,
        float(tally[33:48].sum() + tally[58:65].sum()) / len(raw_bytes),
        float(tally[35:39].sum() + tally[42] + tally[60] + tally[62] + tally[124]) / len(raw_bytes),
        mixed / n,
        float(mixed_hits),
        float(np.log1p(n)),
    ]


@dataclass
class Trees:
    """Boosted trees of fixed depth on binned features: node k has children 2k+1 and 2k+2."""

    edges: list[np.ndarray]
    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self.bin(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, f[node]] > c[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.int16)


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss; splits from histograms of binned features."""
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS)[1:-1])) for i in range(x.shape[1])]
    edges = [np.unique(np.concatenate([e, [0.0]])) for e in edges]
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    t = Trees(edges, float(np.log(p / (1 - p))), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)))
    binned, score, width = t.bin(x), np.full(len(x), t.base), max(len(e) for e in edges) + 1
    inner, features_, cuts, leaves = 2**DEPTH - 1, [], [], []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        f, c, node = np.zeros(inner, np.int64), np.full(inner, width, np.int64), np.zeros(len(x), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = 1e-6
            if len(own) >= 2 * LEAST_LEAF:
                for i in range(x.shape[1]):
                    b = binned[own, i]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, minlength=width)) for w in (g[own], h[own], None))
                    gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
                    gain = gl**2 / (hl + 1) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    gain[(nl < LEAST_LEAF) | (ns[-1] - nl < LEAST_LEAF)] = 0
                    j = int(gain.argmax())
                    if gain[j] > best:
                        best, f[k], c[k] = gain[j], i, j
            node[own] = 2 * k + 1 + (binned[own, f[k]] > c[k])
        at = node - inner
        gs, hs = np.bincount(at, g, 2**DEPTH), np.bincount(at, h, 2**DEPTH)
        leaf = RATE * gs / (hs + 1)
        score += leaf[at]
        features_.append(f), cuts.append(c), leaves.append(leaf)
    t.feature, t.cut, t.leaf = np.array(features_), np.array(cuts), np.array(leaves)
    return t


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and their rising values, each block with one observation
    of the mean added, so that no value is exactly 0 or 1."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, sum, first score, last score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += 1
            blocks[-1][1] += v
        else:
            blocks.append([1.0, v, s, s])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            w, v2, _, last = blocks.pop()
            blocks[-1][0] += w
            blocks[-1][1] += v2
            blocks[-1][3] = last
    mean = float(y.mean())
    xs, ys = [], []
    for w, v, a, b in blocks:
        value = (v + mean) / (w + 1)
        xs += [a, b] if b > a else [a]
        ys += [value] * (2 if b > a else 1)
    return np.array(xs), np.maximum.accumulate(np.array(ys))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, rows: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(rows), self.share)
        x = np.array([features(t, self.lexicon) for t in rows], np.float64).reshape(len(rows), len(FEATURES))
        raw = self.trees.raw(x)
        # A small part of the uncalibrated score keeps the order within a calibrated step.
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 / (1 + np.exp(-raw)), 0.0, 1.0)


def fold(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold(5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows ids and labels: small enough to be sent to every executor.
    # Of rows with one id, that with the least hash of its text is learned from.
    sample = texts(docs).withColumn("__h", F.xxhash64("text")).join(F.broadcast(known), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.struct("__h", "text")).alias("s")).select("doc_id", "s.*")
    sample = sample.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)).cast("int").alias("part"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                tally: tuple[Counter, Counter] = (Counter(), Counter())
                for t, y, part in zip(b["text"][k : k + 500], b["toxic"][k : k + 500], b["part"][k : k + 500], strict=True):
                    if part < 4:
                        own, stems = text_terms(t)
                        tally[y].update(["w" + w for w in own])
                        tally[y].update(["s" + s for s in stems])
                        tally[y]["n"] += 1
                terms = list(tally[1] | tally[0])
                yield pd.DataFrame({"term": terms, "n0": [tally[0][t] for t in terms], "n1": [tally[1][t] for t in terms]}, columns=["term", "n0", "n1"]).astype({"term": str, "n0": "int64", "n1": "int64"})

    counts = sample.mapInPandas(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where((F.col("n1") >= LEAST_SUPPORT) & ((F.col("n1") > 8 * F.col("n0")) | (F.col("term") == "n")))
    counts = counts.orderBy(F.desc("n1"), "term").limit(3 * LEXICON_TERMS).collect()
    total = next(((r.n0, r.n1) for r in counts if r.term == "n"), (0, 0))
    lexicon = Lexicon()
    for r in counts:
        odds = np.log((r.n1 + 0.5) / (total[1] + 1)) - np.log((r.n0 + 0.5) / (total[0] + 1))
        kind = lexicon.words if r.term[0] == "w" else lexicon.stems
        if r.term != "n" and odds >= LEAST_ODDS and len(kind) < LEXICON_TERMS:
            kind[r.term[1:]] = float(odds)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["part"] >= 4]
            yield pd.DataFrame({"x": [features(t, lexicon) for t in b["text"]], "toxic": b["toxic"].values, "part": b["part"].values})

    seen = sample.mapInPandas(measure, "x array<double>, toxic int, part int").toPandas()  # at most sample_rows
    y = seen["toxic"].to_numpy(np.float64)
    if len(seen) < 4 or y.min() == y.max():
        total = known.agg(F.avg("toxic")).first()[0]
        return Model(lexicon, None, None, float(total or 0.0))
    x = np.array(seen["x"].tolist(), np.float64)
    order = np.lexsort(x.T)  # the same model whatever the order of rows
    x, y, part = x[order], y[order], seen["part"].to_numpy()[order]
    own = part < 8 if 0 < y[part < 8].mean() < 1 and 0 < y[part >= 8].sum() else part >= 0
    rest = ~own if (~own).any() else own
    trees = fit_trees(x[own], y[own])
    return Model(lexicon, trees, fit_isotonic(trees.raw(x[rest]), y[rest]), float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:  # ids pass through as they are
            scores = pa.array(model.score(b.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), scores], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, all columns as they were."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    name = "__score"
    while name in docs.columns:
        name += "_"
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        # Columns pass through untouched.
        for b in batches:
            rows = ["" if t is None else t for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(rows), pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema).where(F.col(name) < 0.5).drop(name)
