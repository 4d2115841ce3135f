"""Removal of repeated passages: windows at a difference cover first, then those near their hits.

A string of ``LENGTH`` bytes is removed wherever it starts, if it starts anywhere else. Strings
are compared by hashes, not by their bytes and not in the order of suffixes: nothing is sorted as
text, named by rank or recursed on. What is kept of the difference-cover method is how places are
chosen: modulo ``PERIOD`` the residues ``COVER`` make every difference, so whatever the offset of
two places that share ``LENGTH`` bytes, some offset below ``PERIOD`` leads to a chosen place in
both, and from there they still share ``LENGTH - PERIOD + 1`` bytes. So windows of this length are
hashed at chosen places only; one whose hash comes once rules out the places before it. Around
those that come twice the windows of ``LENGTH`` bytes are hashed, and equal hashes are repeats.

Hashes have 64 bits, and as many more as tell the ranges of hashes apart: results are exact up to
their collisions. A chunk of documents sends each hash once, so no key can be more than one row a
chunk, however often a passage is repeated; the answer is a bit for each hash sent, in the order
sent, and so carries no places. Whole copies of documents are found by digest before and only one
of each group takes part. Chunks are a table in the shared folder, bucketed by chunk: the three
joins of answers with texts read it in place and shuffle answers only.

Null text is empty: nothing to remove. Null ``doc_id`` stays null; repeated rows are copies of
each other; an empty table gives an empty result. Columns besides ``doc_id`` and ``text`` are
ignored. Matches never cross documents; texts are taken whole, a document longer than a chunk
is a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_table, rows
from .common import materialise, texts

LENGTH = 200
#: A perfect difference set, fixed values: each difference mod PERIOD but 0 occurs once.
PERIOD, COVER = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
CHUNK_BYTES = 2_000_000
#: Hashes that meet in one range of the order.
RANGE_HASHES = 1_000_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, (2, 256)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) < n:
        n = max(n, CHUNK_BYTES + 4096)
        base = np.full(n, _BASE[which], np.uint64)
        inverse = np.full(n, pow(_BASE[which], -1, 2**64), np.uint64)
        base[0] = inverse[0] = 1
        _powers[which] = np.cumprod(base), np.cumprod(inverse)
    return _powers[which]


def window_hashes(data: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hashes of the strings of ``length`` bytes that start at the places ``at``."""
    up, down = _power(which, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[which][data] * up[: len(data)], out=total[1:])
    h = (total[at + length] - total[at]) * down[at]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class Chunk:
    """Some documents as one byte array; which of them take part."""

    def __init__(self, blob: bytes, sizes: np.ndarray, copies: np.ndarray, kept_copies: np.ndarray):
        self.data, self.sizes = np.frombuffer(blob, np.uint8), sizes
        self.starts = np.cumsum(sizes) - sizes
        self.whole = np.zeros(len(sizes), bool)  # copies: they go as a whole
        self.whole[copies] = True
        self.whole &= sizes >= LENGTH
        out = np.zeros(len(sizes), bool)
        out[copies] = True
        out[kept_copies] = False
        self.active = ~out & (sizes >= LENGTH)
        own = np.where(self.active, sizes, 0)
        rel = np.arange(int(own.sum()), dtype=np.int64) - np.repeat(np.cumsum(own) - own, own)
        self.place = np.repeat(self.starts, own) + rel
        self.rel, self.left = rel, np.repeat(sizes, own) - rel

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places and the hashes of their tuples."""
        tuple_ = LENGTH - PERIOD + 1
        inside = np.zeros(PERIOD, bool)
        inside[list(COVER)] = True
        at = self.place[inside[self.rel % PERIOD] & (self.left >= tuple_)]
        return at, window_hashes(self.data, at, tuple_)

    def remaining(self, at: np.ndarray) -> np.ndarray:
        """Places from which ``LENGTH`` bytes of the document start, before a sampled place of
        ``at`` by less than PERIOD."""
        mark = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(mark, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(mark, at + 1, -1)
        near = np.cumsum(mark[:-1]) > 0
        return self.place[near[self.place] & (self.left >= LENGTH)]


class Sent:
    """Distinct hashes of a chunk in the order in which they are sent, by range."""

    def __init__(self, hashes: np.ndarray, ranges: np.ndarray):
        order = np.lexsort((hashes, ranges))
        h, r = hashes[order], ranges[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        group = np.cumsum(fresh) - 1
        self.which = np.empty(len(h), np.int64)
        self.which[order] = group
        self.hashes, self.ranges = h[fresh], r[fresh]
        self.twice = np.bincount(group, minlength=len(self.hashes)) > 1
        self.cuts = np.flatnonzero(np.diff(self.ranges)) + 1

    def payloads(self) -> tuple[np.ndarray, list[bytes]]:
        if not len(self.hashes):
            return np.zeros(0, np.int64), []
        return self.ranges[np.concatenate([[0], self.cuts])], [x.astype("<u8").tobytes() for x in np.split(self.hashes, self.cuts)]

    def answer(self, masks: dict[int, bytes]) -> np.ndarray:
        """For each hash given at first: does it occur twice, here or elsewhere?"""
        twice = self.twice.copy()
        if len(self.hashes):
            edges = [0, *self.cuts.tolist(), len(self.hashes)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if bits := masks.get(int(self.ranges[a])):
                    twice[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return twice[self.which]


def _first(chunk: Chunk, ranges: int) -> tuple[np.ndarray, Sent]:
    at, h = chunk.sampled()
    return at, Sent(h, (h >> np.uint64(40)).astype(np.int64) % ranges)


def _second(chunk: Chunk, ranges: int, masks: dict[int, bytes], first_ranges: int) -> tuple[np.ndarray, Sent]:
    at, sent = _first(chunk, first_ranges)
    at = chunk.remaining(at[sent.answer(masks)])
    other = window_hashes(chunk.data, at, LENGTH, 1)
    return at, Sent(window_hashes(chunk.data, at, LENGTH), (other >> np.uint64(40)).astype(np.int64) % ranges)


def _copies(chunks: DataFrame) -> DataFrame:
    """``chunk, copies``: of each chunk the documents that have copies, and whether one takes
    part for its group. Copies within a chunk are one row (chunks are bucketed, so that takes no
    shuffle): a text has a row for each chunk it is in, however often it is repeated."""
    each = chunks.select("chunk", F.posexplode("digests").alias("k", "digest"))
    own = each.groupBy("chunk", "digest").agg(F.collect_list("k").alias("ks"))
    first = F.min(F.struct("chunk", F.array_min("ks").alias("k"))).alias("least")
    groups = own.groupBy("digest").agg(F.sum(F.size("ks")).alias("n"), first).where("n > 1").select("digest", "least")
    stays = lambda k: (F.col("chunk") == F.col("least.chunk")) & (k == F.col("least.k"))
    marked = own.join(groups, "digest").select("chunk", F.transform("ks", lambda k: F.struct(k.alias("k"), stays(k).alias("stays"))).alias("some"))
    return marked.groupBy("chunk").agg(F.flatten(F.collect_list("some")).alias("copies"))


def _twice(sent: pd.DataFrame) -> pd.DataFrame:
    """Which hashes of one range come from more than one chunk: a bit for each hash sent."""
    sizes = [len(p) // 8 for p in sent["hashes"]]
    every = np.frombuffer(b"".join(sent["hashes"]), "<u8")
    order = np.sort(every)
    same = order[1:][order[1:] == order[:-1]]
    hit = np.isin(every, same) if len(same) else np.zeros(len(every), bool)
    masks, at = [], 0
    for n in sizes:
        masks.append(np.packbits(hit[at : at + n]).tobytes() if hit[at : at + n].any() else None)
        at += n
    out = pd.DataFrame({"chunk": sent["chunk"], "range": sent["range"], "mask": masks})
    return out[out["mask"].notna()]


def _answers(sent: DataFrame, name: str) -> DataFrame:
    masks = sent.groupBy("range").applyInPandas(_twice, "chunk long, range long, mask binary")
    return masks.groupBy("chunk").agg(F.collect_list(F.struct("range", "mask")).alias(name))


def _open(row: dict) -> Chunk:
    copies = row["copies"] or []
    return Chunk(row["blob"], np.array(row["sizes"], np.int64), np.array([c["k"] for c in copies], np.int64), np.array([c["k"] for c in copies if c["stays"]], np.int64))


def _masks(some) -> dict[int, bytes]:
    return {m["range"]: m["mask"] for m in some or []}


def _sent(chunk: int, sent: Sent) -> pa.RecordBatch:
    ranges, payloads = sent.payloads()
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(payloads), pa.int64()), pa.array(ranges, pa.int64()), pa.array(payloads, pa.binary())], names=["chunk", "range", "hashes"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay) of every row."""
    own = texts(docs)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, _ = chunk_table(own, total, CHUNK_BYTES)
    first_ranges = max(1, -(-total * len(COVER) // (PERIOD * RANGE_HASHES)))
    second_ranges = max(1, -(-total // (4 * RANGE_HASHES)))
    copies = _copies(chunks)
    held = chunks.join(copies, "chunk", "left").select("chunk", "sizes", "blob", "copies")

    def send_first(batches):
        for row in rows(batches):
            yield _sent(row["chunk"], _first(_open(row), first_ranges)[1])

    payload = "chunk long, range long, hashes binary"
    masks1 = _answers(held.mapInArrow(send_first, payload), "m1")

    def send_second(batches):
        for row in rows(batches):
            yield _sent(row["chunk"], _second(_open(row), second_ranges, _masks(row["m1"]), first_ranges)[1])

    masks1 = materialise(masks1, "repeats-sampled")
    masks2 = materialise(_answers(held.join(masks1, "chunk", "left").mapInArrow(send_second, payload), "m2"), "repeats-merged")

    def finish(batches):
        for row in rows(batches):
            c = _open(row)
            at, sent = _second(c, second_ranges, _masks(row["m1"]), first_ranges)
            at = at[sent.answer(_masks(row["m2"]))]
            mark = np.zeros(len(c.data) + 1, np.int32)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + LENGTH, -1)
            gone = np.cumsum(mark[:-1]) > 0
            out = []
            for doc, a, n, whole in zip(row["ids"], c.starts.tolist(), c.sizes.tolist(), c.whole.tolist(), strict=True):
                g = np.ones(n, bool) if whole else gone[a : a + n]
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
                out.append((doc, n, int(g.sum()), spans, c.data[a : a + n][~g].tobytes()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    last = chunks.select("chunk", "ids", "sizes", "blob").join(copies, "chunk", "left").join(masks1, "chunk", "left").join(masks2, "chunk", "left")
    return last.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
