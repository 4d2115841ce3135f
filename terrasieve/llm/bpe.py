"""Byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

Each pre-token of a text is one row of bytes. Rows of similar length share a padded matrix;
every round merges, in every row, the leftmost pair of least rank. Pair ranks come from an
open-addressing hash table held in two numpy arrays. A merged row is compacted to the left, a
row without a pair left leaves the matrix. Spark deals out the documents; the vocabulary is a
file whose path is a parameter, read once per Python worker.

Null text counts as empty (no tokens), null ``doc_id`` stays null, repeated rows each give a
row, other columns are ignored. An empty table gives an empty result. A text is never cut.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

NONE = np.int32(2**31 - 1)
#: Characters of text that are split and encoded together in a worker.
SLICE_CHARS = 1_500_000
#: Entries of a worker's table of pre-tokens; at the bound it starts anew.
CACHE_ENTRIES = 500_000
#: A row at least this long merges all its leftmost pairs of least rank in one round.
LONG_ROW = 256
ENCODED_SCHEMA = "doc_id long, ids array<int>"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from lines of base64 bytes and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """Rank of the token that two adjacent tokens form, by open addressing."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens) if t}
        left, right, out = [], [], []
        for t, r in rank.items():
            for cut in range(1, len(t)):
                a = rank.get(t[:cut])
                if a is not None and (b := rank.get(t[cut:])) is not None:
                    left.append(a), right.append(b), out.append(r)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        values = np.array(out, np.int32)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            # Of the keys that want one free slot, the first takes it.
            want, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[want], self.values[want] = keys[placed], values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the two form no token; ids below 0 are padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys = np.where((left < 0) | (right < 0), -2, keys)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1) & (keys >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class MatrixBpe:
    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.pairs = PairTable(tokens)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.rank.get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(p) >= LONG_ROW:
                out[i] = self._long(p)
            else:
                width = 4 if len(p) <= 4 else 8 if len(p) <= 8 else 12 if len(p) <= 12 else 1 << (len(p) - 1).bit_length()
                buckets.setdefault(width, []).append(i)
        for width, rows in buckets.items():
            step = max(64, 400_000 // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.array([len(p) for p in pieces], np.int32)
        column = np.arange(width, dtype=np.int32)
        ids = np.where(column < size[:, None], self.byte[flat], np.int32(-1))
        rank = self.pairs.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        rank = np.concatenate([rank, np.full((len(ids), 1), NONE, np.int32)], axis=1)
        row, done = np.arange(len(ids)), [b""] * len(pieces)
        while len(row):
            at = rank.argmin(axis=1)  # the first of equal ranks
            here = np.arange(len(row))
            least = rank[here, at]
            if (ended := least == NONE).any():
                buf, stride = ids[ended].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (r, n) in enumerate(zip(row[ended].tolist(), size[ended].tolist(), strict=True)):
                    done[r] = buf[k * stride : k * stride + 4 * n]
                live = ~ended
                ids, rank, row, size, at, least = ids[live], rank[live], row[live], size[live], at[live], least[live]
                here = np.arange(len(row))
                if not len(row):
                    break
            # Compaction: what lies right of the pair moves one column to the left.
            shift = np.minimum(column + (column > at[:, None]), ids.shape[1] - 1)
            ids, rank = np.take_along_axis(ids, shift, 1), np.take_along_axis(rank, shift, 1)
            ids[here, at] = least
            size -= 1
            last = ids.shape[1] - 1
            ids[:, last], rank[:, last] = -1, NONE
            after = np.where(at + 1 <= last, ids[here, np.minimum(at + 1, last)], -1)
            rank[here, at] = self.pairs.lookup(least, after)
            inner = at > 0
            r, c = here[inner], at[inner]
            rank[r, c - 1] = self.pairs.lookup(ids[r, c - 1], least[inner])
            if (used := int(size.max())) < ids.shape[1]:
                ids, rank, column = ids[:, :used], rank[:, :used], column[:used]
                if used == 1:
                    rank[:] = NONE
        return done

    def _long(self, piece: bytes) -> bytes:
        """One long row. A round merges the leftmost pair of least rank and goes on to the
        next pair of that rank as long as no merge has formed a pair of that rank or less,
        which is the order that single merges would take."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.lookup(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            hits = np.flatnonzero(rank == least)
            if len(hits) > 1:  # pairs that overlap: each second one of a run goes first
                start = np.concatenate([[True], np.diff(hits) > 1])
                first = np.maximum.accumulate(np.where(start, np.arange(len(hits)), 0))
                hits = hits[(np.arange(len(hits)) - first) % 2 == 0]
            merged = ids.copy()
            merged[hits] = least
            drop = np.zeros(len(ids), bool)
            drop[hits + 1] = True
            new = merged[~drop]
            at = hits - np.arange(len(hits))
            left = np.where(at > 0, self.pairs.lookup(new[np.maximum(at - 1, 0)], new[at]), NONE)
            follow = np.minimum(at + 1, len(new) - 1)
            right = np.where(at + 1 < len(new), self.pairs.lookup(new[at], new[follow]), NONE)
            # Also the pairs that stand before a later merge of this round.
            nxt = np.minimum(hits + 2, len(ids) - 1)
            raw = np.where(hits + 2 < len(ids), self.pairs.lookup(np.full(len(hits), least, np.int32), ids[nxt]), NONE)
            early = np.flatnonzero((left <= least) | (right <= least) | (raw <= least))
            if len(early) and early[0] + 1 < len(hits):
                hits = hits[: early[0] + 1]
                merged = ids.copy()
                merged[hits] = least
                drop[:] = False
                drop[hits + 1] = True
                new = merged[~drop]
                at = hits - np.arange(len(hits))
            kept = rank[~drop[:-1]] if not drop[-1] else rank[~drop[:-1]][: len(new) - 1]
            rank = kept[: len(new) - 1].copy()
            for side in (at - 1, at):
                side = side[(side >= 0) & (side < len(new) - 1)]
                rank[side] = self.pairs.lookup(new[side], new[side + 1])
            ids = new
        return ids.astype("<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.tokens[i] for i in ids.tolist()])


_models: dict[str, MatrixBpe] = {}


def model(path: str) -> MatrixBpe:
    if path not in _models:
        _models[path] = MatrixBpe(load_ranks(path))
    return _models[path]


class TextEncoder:
    """Splits whole texts by the pattern and encodes each match separately."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.bpe, self.split, self.known = model(path), regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= SLICE_CHARS):
                chars += len(texts[stop])
                stop += 1
            pieces = [self.split(t) for t in texts[at:stop]]
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            new = list({p for some in pieces for p in some if p not in self.known})
            self.known.update(zip(new, self.bpe.encode_pieces([p.encode() for p in new]), strict=True))
            get = self.known.__getitem__
            for some in pieces:
                yield b"".join(map(get, some))
            at = stop


def _default(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path and pattern:
        return path, pattern
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id`` and the ids of its whole text. ``path``: rank file; ``pattern``: the split."""
    path, pattern = _default(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TextEncoder(path, pattern)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in enc.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, ENCODED_SCHEMA)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and the bytes of its ids, from what ``encode`` returns (null ids: empty)."""
    path, _ = _default(path, "-")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            out = [bpe.decode(np.array(x, np.int64)) if x is not None else b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document the count and digest of its ids and the digest of the bytes that they
    decode to. Both ways run in one pass, so that ids needn't leave the worker."""
    path, pattern = _default(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TextEncoder(path, pattern)
        for b in batches:
            n, own, decoded = [], [], []
            for raw in enc.encode(b.column(1).to_pylist()):
                back = enc.bpe.decode(np.frombuffer(raw, "<u4"))
                n.append(len(raw) // 4)
                own.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, DIGEST_SCHEMA)
