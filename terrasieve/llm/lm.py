"""Language-model scores: word counts of the corpus, and a causal self-attention model.

Tokens are lower-cased words and one end. Two things are learned from the training rows:

* counts of every word (the base score), exact over all of them. A chunk of documents sends
  each distinct word once, as a 64-bit hash with its count there, to a range of hashes; the
  range answers with the total of each hash, in the order sent. No vocabulary is ever whole in
  one place, and a word that is in every document is one row a chunk.
* a model over subword ids (``attention``). Ids are byte-pair ids of each word with a space
  before it. Their ``IDS`` ranks are learned from the training rows: the most frequent words by
  those exact counts are merged pair by pair (``fit_ranks``), so that a text has few ids; bytes
  are ids too, so every word has some. Or they are the first ``IDS`` ranks of a rank file (ranks
  only build on lower ones, so that is a vocabulary of its own). Classes of ids go by counts over
  all training rows, ids that open a word (or end the text) apart from those that go on with one,
  and the output biases start from the logs of the counts.

Training: one pass over every window of every training document, at all sizes. The chunks of a
task are a replica, and the windows of each chunk, side by side, are dealt to ``ROUNDS`` rounds;
in a round every replica takes Adam steps from the current weights over its windows of that
round, and weights are averaged by windows seen, in a tree of ``FAN_IN``. A task holds about
``TASK_BYTES`` of text: more data means more replicas, not longer ones.

Scoring: windows of ``WIDTH`` ids overlap by ``CONTEXT``; each id is scored once, in the window
that gives it at least so much to look back on (less only at the start of a text). The ids of a
word and the chance that it stops there make the word's probability. The score is the sum of its
log10 over the words and the end: the network's alone, counts of words have no part in it.

Texts are read once: a chunk's distinct words, and the place of each of its words among them, are
a table bucketed by chunk; its ids are another one with the same buckets, so that answers and ids
meet it without moving it.

Null text is empty: one token, the end. Rows with a null ``doc_id`` are scored, never learned
from, and are not held out. Repeated rows count each. An empty table gives an empty result;
without training rows counts are 0 and the model is its start. Columns besides ``doc_id`` and
``text`` are ignored. Texts are scored whole, however long: a document longer than a chunk is a
chunk.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import heapq
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import (
    CONTEXT,
    IDS,
    RATE,
    SCORE_BATCH,
    WIDTH,
    log_probabilities,
    n_classes,
    slots,
    start_weights,
    take_steps,
    views,
)
from .chunks import packed, rows, write_table
from .common import materialise, texts

CHUNK_BYTES = 4_000_000
RANGE_WORDS = 1_000_000
ROUNDS = 4
#: Bytes of text that one task, a replica, trains on; it answers with one set of weights a round.
TASK_BYTES = 32_000_000
FAN_IN = 8
ADD = 0.1
#: Words that ranks are learned from, and how often a pair must be there to be merged.
FIT_WORDS, LEAST_SEEN = 20_000, 200


def _keep_memory() -> None:
    """Tells the C library to reuse large blocks: a worker frees and takes arrays of the same
    size over and over, and fresh pages cost more than the arithmetic on them."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 28)
        libc.mallopt(-1, 1 << 28)


# ---- words and subword ids -------------------------------------------------------------------


def file_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return {k: v for k, v in ranks.items() if v < IDS}


def fit_ranks(counts: dict[bytes, int]) -> dict[bytes, int]:
    """Byte-pair ranks of words that stand so often, with a space before them: all bytes, and then
    the most frequent pair of neighbours becomes one, again and again (ties by the bytes)."""
    words = [([bytes([b]) for b in b" " + w], n) for w, n in counts.items()]
    pairs: Counter = Counter()
    where = defaultdict(set)
    for i, (parts, n) in enumerate(words):
        for pair in zip(parts, parts[1:]):
            pairs[pair] += n
            where[pair].add(i)
    ranks = {bytes([b]): b for b in range(256)}
    heap = [(-n, pair) for pair, n in pairs.items()]
    heapq.heapify(heap)
    while heap and len(ranks) < IDS:
        n, pair = heapq.heappop(heap)
        if -n != pairs[pair]:  # it has changed meanwhile
            if pairs[pair]:
                heapq.heappush(heap, (-pairs[pair], pair))
            continue
        if -n < LEAST_SEEN:
            break
        whole, touched = pair[0] + pair[1], set()
        ranks.setdefault(whole, len(ranks))
        for i in where.pop(pair):
            parts, n = words[i]
            after: list[bytes] = []
            at = 0
            while at < len(parts):
                step = 2 if (*parts[at : at + 2],) == pair else 1
                after.append(whole if step == 2 else parts[at])
                at += step
            for old in zip(parts, parts[1:]):
                pairs[old] -= n
                touched.add(old)
            for new in zip(after, after[1:]):
                pairs[new] += n
                where[new].add(i)
                touched.add(new)
            words[i] = after, n
        for x in touched:
            if pairs[x]:
                heapq.heappush(heap, (-pairs[x], x))
    return ranks


class Subwords:
    def __init__(self, ranks: str | dict[bytes, int]):
        import tiktoken

        ranks = file_ranks(ranks) if isinstance(ranks, str) else ranks
        self.encoding = tiktoken.Encoding("prefix", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(IDS, bool)  # only a word's first id starts with a space
        self.opens[[v for k, v in ranks.items() if k[:1] == b" "]] = True

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each word's begin (one more for the end)."""
        joined = b"".join([b" " + w for w in words]).decode("utf-8", "replace")
        ids = np.array(self.encoding.encode_ordinary(joined), np.int32)
        return ids, np.append(np.flatnonzero(self.opens[ids]), len(ids)) if len(ids) else np.zeros(1, np.int64)


_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(20240301).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word of a chunk, from running sums of its bytes."""
    n = len(data) + 1
    total = np.zeros(n, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n)[:-1], out=total[1:])
    return (total[end] - total[start]) * _powers(pow(_BASE, -1, 2**64), n)[start]


#: Powers of each base, as many as a chunk at most has bytes (but for one of a longer document).
_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if n <= len(_known.get(base, ())):
        return _known[base][:n]
    out = np.full(max(n, CHUNK_BYTES + 65_536), base, np.uint64)
    out[0] = 1
    np.cumprod(out, out=out)
    if n <= CHUNK_BYTES + 65_536:
        _known[base] = out
    return out[:n]


class Text:
    """A chunk's words: distinct ones, their hashes, and the number of each word in order."""

    def __init__(self, ids: list[int | None], raw: list[bytes]):
        import xxhash

        self.ids, blob = ids, b" ".join(raw).lower()
        data = np.frombuffer(blob, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~_GAP[data]
        turn = np.diff(inside)
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        begin = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
        self.lengths = np.bincount(np.searchsorted(begin, start, "right") - 1, minlength=len(raw)).astype(np.int64)
        key = _word_keys(data, start, end)
        self.number, distinct = pd.factorize(key)
        first = np.empty(len(distinct), np.int64)
        first[self.number[::-1]] = np.arange(len(key))[::-1]  # the last that is put stays: the first word
        self.words = [blob[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        digest = xxhash.xxh64_intdigest
        self.hashes = np.fromiter(map(digest, self.words), np.uint64, len(self.words))
        crc = [None if i is None else zlib.crc32(str(i).encode()) for i in ids]
        self.held_out = np.array([c is not None and c % 10 == 0 for c in crc], bool)
        self.train = np.array([c is not None and c % 10 != 0 for c in crc], bool)

    def training_counts(self) -> np.ndarray:
        return np.bincount(self.number[np.repeat(self.train, self.lengths)], minlength=len(self.words))

    def subwords(self, sub: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return subword_ids(sub, self.words, self.number, self.lengths, self.train)


def subword_ids(sub: Subwords, words: list[bytes], number: np.ndarray, own: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' ids one after the other, each ended by IDS, their lengths, and the counts of
    ids in the training documents: of distinct words, the number of each word in order, and how
    many words each document has."""
    flat, edge = sub.encode(words)
    seen = np.bincount(number[np.repeat(train, own)], minlength=len(words))
    counts = np.bincount(flat, np.repeat(seen, np.diff(edge)), minlength=IDS + 1).astype(np.int64)
    counts[IDS] = train.sum()
    size = np.diff(edge)[number]
    doc = np.repeat(np.arange(len(own)), own)
    lengths = np.bincount(doc, size, minlength=len(own)).astype(np.int64)
    out = np.full(int((lengths + 1).sum()), IDS, np.int16)
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum()))
    # An end stands before each later document.
    out[place + np.repeat(doc, size)] = flat[place + np.repeat(edge[:-1][number] - before, size)]
    return out, lengths + 1, counts


def windows(ids: np.ndarray, lengths: np.ndarray, overlap: int = CONTEXT, kept: slice = slice(None)) -> tuple[np.ndarray, ...]:
    """Inputs, targets (-1: not there), first scored column, document and first place (in all
    ids) of every window, or of those kept. The input at a place is the id before it, the end at
    the start of a document."""
    step = WIDTH - overlap
    count = 1 + np.maximum(0, -(-(lengths - WIDTH) // step))
    doc = np.repeat(np.arange(len(lengths)), count)[kept]
    k = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))[kept]
    start = (np.cumsum(lengths) - lengths)[doc] + k * step
    row = np.concatenate([np.full(1, IDS, ids.dtype), ids, np.zeros(WIDTH, ids.dtype)])
    row = np.lib.stride_tricks.sliding_window_view(row, WIDTH + 1)[start]
    gone = np.arange(WIDTH) >= (lengths[doc] - k * step)[:, None]
    given, target = row[:, :-1].astype(np.int32), row[:, 1:].astype(np.int32)
    given[gone], target[gone] = IDS, -1
    given[k == 0, 0] = IDS
    return given, target, np.where(k > 0, overlap, 0), doc, start


def round_windows(ids: np.ndarray, lengths: np.ndarray, learn: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of the windows that a replica trains on in round r. Windows stand side
    by side, so each id of its training documents is a target once in all rounds."""
    given, target, *_ = windows(ids[np.repeat(learn, lengths)], lengths[learn], 0, slice(r, None, ROUNDS))
    return given, target


# ---- Spark -----------------------------------------------------------------------------------


def _tree(parts: DataFrame, n: int, combine, schema: str) -> list:
    """The rows of ``parts (g, ...)`` for g in 0 to n - 1, combined by FAN_IN until few are left."""
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.withColumn("g", F.pmod("g", F.lit(n))).groupBy("g").applyInPandas(combine, f"g long, {schema}")
    return parts.collect()


def _sent(text: Text, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order in which a chunk's words are sent, the range of each in this order, and its cuts."""
    own = (text.hashes >> np.uint64(32)).astype(np.int64) % ranges
    order = np.lexsort((text.hashes, own))
    return order, own[order], np.flatnonzero(np.diff(own[order])) + 1


def _totals(sent: pd.DataFrame) -> pd.DataFrame:
    """The total count of each hash of one range, in the order in which each chunk sent them,
    and a row without a chunk: how many of them have a count, the sum of counts, and the most
    frequent words with theirs."""
    h = np.frombuffer(b"".join(sent["hashes"]), "<u8")
    n = np.frombuffer(b"".join(sent["counts"]), "<u4").astype(np.int64)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    total = np.bincount(inverse, n).astype(np.int64)
    told = total[inverse].astype("<u8")
    edge = np.cumsum([0] + [len(x) // 8 for x in sent["hashes"]])
    parts = zip(sent["chunk"], sent["range"], edge[:-1], edge[1:], strict=True)
    out = [(c, r, told[a:b].tobytes(), None, None, None) for c, r, a, b in parts]
    words = b" ".join(sent["distinct"]).split(b" ")
    most = [(words[first[i]], int(total[i])) for i in _most_frequent(total, [words[k] for k in first]) if total[i]]
    out.append((None, sent["range"].iloc[0], None, int((total > 0).sum()), int(total.sum()), most))
    return pd.DataFrame(out, columns=["chunk", "range", "totals", "v", "n", "most"]).astype({"chunk": "Int64", "v": "Int64", "n": "Int64"})


def _most_frequent(total: np.ndarray, words: list[bytes]) -> list[int]:
    """Where the FIT_WORDS greatest counts are, ties by word."""
    if len(total) > FIT_WORDS:
        near = np.flatnonzero(total >= np.partition(total, -FIT_WORDS)[-FIT_WORDS])
    else:
        near = np.arange(len(total))
    return sorted(near.tolist(), key=lambda i: (-total[i], words[i]))[:FIT_WORDS]


def _add_up(some: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<i8") for x in some["counts"])
    return pd.DataFrame({"g": some["g"].iloc[:1], "counts": [total.tobytes()]})


def _mean(some: pd.DataFrame) -> pd.DataFrame:
    share = some["n"] / some["n"].sum()
    w = sum(np.frombuffer(x, "<f4") * np.float32(s) for x, s in zip(some["w"], share, strict=True))
    return pd.DataFrame({"g": some["g"].iloc[:1], "n": [int(some["n"].sum())], "w": [w.astype("<f4").tobytes()]})


def _replicas(now: np.ndarray, place: np.ndarray, rate: float, r: int):
    """A task's part of a round: from the weights of now to its own, over all windows of its
    chunks in this round."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        _keep_memory()
        dealt = []
        for part in parts:
            for ids, lengths, learn in zip(part["subwords"], part["lengths"], part["learn"], strict=True):
                dealt.append(round_windows(np.frombuffer(ids, "<i2"), np.frombuffer(lengths, "<i8"), np.frombuffer(learn, bool), r))
        given, target = (np.concatenate(x) for x in zip(*dealt, strict=True)) if dealt else ((), ())
        if len(given):
            w = take_steps(now, place, given, target, rate, 100 + r)
            yield pd.DataFrame({"g": [TaskContext.get().partitionId()], "n": [len(given)], "w": [w.astype("<f4").tobytes()]})

    return run


def train(replicas: DataFrame, counts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Weights from replicas (``subwords, lengths, learn``: packed ids and lengths of documents,
    and which of them are for training)."""
    flat, n = start_weights(counts, place), replicas.rdd.getNumPartitions()
    for r in range(ROUNDS):
        means = replicas.mapInPandas(_replicas(flat, place, RATE * (1 - r / ROUNDS), r), "g long, n long, w binary")
        found = _tree(means, n, _mean, "n long, w binary")
        if found:
            flat = np.frombuffer(_mean(pd.DataFrame([x.asDict() for x in found]))["w"].iloc[0], "<f4").copy()
    return flat


def word_scores(w: dict, place: np.ndarray, opening: int, opens: np.ndarray, ids: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The log10 probability of each document of so many ids and words."""
    given, target, first, _, start = windows(ids, lengths)
    lp, lo = np.zeros(len(ids)), np.zeros(len(ids))
    for a in range(0, len(given), SCORE_BATCH):
        own = slice(a, a + SCORE_BATCH)
        p, o, r, k = log_probabilities(w, place, opening, given[own], target[own], first[own])
        at = start[own][r] + k
        lp[at], lo[at] = p, o
    # The chance that a word opens is what stops the word before; at the start it is 1.
    begin = np.flatnonzero(opens[ids])
    lp[begin] -= lo[begin]
    ended = np.append(lo[begin[1:]], 0.0)
    each = np.add.reduceat(lp, begin) + np.where(ids[begin] == IDS, 0.0, ended)
    return np.bincount(np.repeat(np.arange(len(lengths)), words + 1), each / math.log(10), minlength=len(lengths))


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row, with
    ids by ranks learned from the training rows, or those of a file."""
    own = texts(docs)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-total // (24 * RANGE_WORDS)))
    schema = "chunk long, range long, hashes binary, counts binary, distinct binary, ids array<long>, held_out array<boolean>, learn binary, words binary, number binary"
    binary = ("hashes", "counts", "distinct", "learn", "words", "number", "lengths", "subwords", "id_counts")
    fields = [("chunk", pa.int64()), ("range", pa.int64()), ("ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_()))]
    kinds = dict(fields) | {k: pa.binary() for k in binary}
    layout = lambda schema: pa.schema([(part.split()[0], kinds[part.split()[0]]) for part in schema.split(", ")])

    def gather(batches):
        """What a chunk sends to ranges of words, and what is needed of it later on."""
        _keep_memory()
        for chunk, ids, raw in packed(batches, CHUNK_BYTES):
            t = Text(ids, raw)
            order, own, cuts = _sent(t, ranges)
            where = np.empty(len(order), np.int32)
            where[order] = np.arange(len(order))
            words, edge = [t.words[i] for i in order.tolist()], [0, *cuts.tolist(), len(order)]
            out = []
            if len(order):
                h, n = t.hashes[order].astype("<u8"), t.training_counts()[order].astype("<u4")
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    out.append({"range": int(own[a]), "hashes": h[a:b].tobytes(), "counts": n[a:b].tobytes(), "distinct": b" ".join(words[a:b])})
            out.append(
                {
                    "distinct": b" ".join(words),
                    "ids": t.ids,
                    "held_out": t.held_out.tolist(),
                    "learn": t.train.tobytes(),
                    "words": t.lengths.tobytes(),
                    "number": where[t.number].astype("<i4").tobytes(),
                }
            )
            yield pa.RecordBatch.from_pylist([{"chunk": chunk} | x for x in out], schema=layout(schema))

    gathered, drop = write_table(own.mapInArrow(gather, schema), total)
    sent = gathered.where("range is not null").select("chunk", "range", "hashes", "counts", "distinct")
    answers = sent.groupBy("range").applyInPandas(_totals, "chunk long, range long, totals binary, v long, n long, most array<struct<word: binary, n: long>>")
    answers = materialise(answers, "lm-words")
    found = answers.where("chunk is null").agg(F.sum("v"), F.sum("n")).first()
    each = gathered.where("ids is not null")
    if path is None:
        most = answers.where("chunk is null").select(F.explode("most").alias("m")).select("m.word", "m.n")
        # Written first: collected at once, each partition would send its own FIT_WORDS to the driver.
        most = materialise(most.orderBy(F.desc("n"), "word").limit(FIT_WORDS), "lm-most")
        ranks = fit_ranks({bytes(r.word): r.n for r in most.collect()})
    else:
        ranks = file_ranks(path)
    encoded = "chunk long, learn binary, lengths binary, subwords binary, id_counts binary"

    def encode(batches):
        _keep_memory()
        sub = Subwords(ranks)
        for row in rows(batches):
            words, learn = row["distinct"].split(b" ") if row["distinct"] else [], np.frombuffer(row["learn"], bool)
            subwords, lengths, counts = subword_ids(sub, words, np.frombuffer(row["number"], "<i4"), np.frombuffer(row["words"], "<i8"), learn)
            out = {"chunk": row["chunk"], "learn": row["learn"], "lengths": lengths.tobytes(), "subwords": subwords.astype("<i2").tobytes(), "id_counts": counts.astype("<i8").tobytes()}
            yield pa.RecordBatch.from_pylist([out], schema=layout(encoded))

    with_ids, drop_ids = write_table(each.select("chunk", "distinct", "number", "words", "learn").mapInArrow(encode, encoded), total)

    def add(parts):
        from pyspark import TaskContext

        total = None
        for part in parts:
            for x in part["id_counts"]:
                total = np.frombuffer(x, "<i8") + (0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({"g": [TaskContext.get().partitionId()], "counts": [total.tobytes()]})

    parts = with_ids.select("id_counts").mapInPandas(add, "g long, counts binary")
    parts = _tree(parts, with_ids.rdd.getNumPartitions(), _add_up, "counts binary")
    counts = sum((np.frombuffer(r.counts, "<i8") for r in parts), np.zeros(IDS + 1, np.int64))
    ends = int(counts[IDS])
    big_v, big_n = int(found[0] or 0) + (ends > 0), int(found[1] or 0) + ends
    opens = np.append(Subwords(ranks).opens, True)
    place, opening = slots(counts, opens)
    replicas = with_ids.select("subwords", "lengths", "learn")
    flat = train(replicas.coalesce(max(own.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES)), counts, place)
    low = big_n + ADD * (big_v + 1)
    log_end = math.log10((ends + ADD) / low)
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

    def finish(batches):
        _keep_memory()
        model = views(flat, n_classes(place))
        for row in rows(batches):
            words, lengths = np.frombuffer(row["words"], "<i8"), np.frombuffer(row["lengths"], "<i8")
            told = sorted((a["range"], a["totals"]) for a in row["answers"] or [])
            totals = np.frombuffer(b"".join(x for _, x in told), "<u8").astype(np.int64)
            doc = np.repeat(np.arange(len(words)), words)
            c = totals[np.frombuffer(row["number"], "<i4")]
            base = np.bincount(doc, np.log10((c + ADD) / low), minlength=len(words)) + log_end
            known = np.bincount(doc, c > 0, minlength=len(words)).astype(np.int64) + (ends > 0)
            result = word_scores(model, place, opening, opens, np.frombuffer(row["subwords"], "<i2"), lengths, words)
            columns = [
                pa.array(row["ids"], pa.int64()),
                pa.array(row["held_out"], pa.bool_()),
                pa.array(words + 1),
                pa.array(known),
                pa.array(np.full(len(words), big_n)),
                pa.array(base),
                pa.array(result),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=list(names))

    by_chunk = answers.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("range", "totals")).alias("answers"))
    held = each.select("chunk", "ids", "held_out", "words", "number").join(with_ids.select("chunk", "lengths", "subwords"), "chunk").join(by_chunk, "chunk", "left")
    out = held.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = materialise(out, "lm-scores")
    drop(), drop_ids()
    return out
