"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 bits over the XXH64 hashes of a text's three-word shingles. Two fingerprints
link at ``THRESHOLD`` or fewer differing bits, links make components.

Search: the anchors are the code words of a covering code. A block of 23 bits of the
fingerprint has the perfect binary Golay code, 4,096 words that cover all 23-bit words within
radius 3. A fingerprint is the guest of its own anchor and is replicated to every anchor that a
fingerprint within the threshold of it could own (the anchors within covering radius plus
threshold). So both ends of a link meet at the anchor of either end, and comparing guests with
owners per anchor finds every link.

An anchor that more than ``OWNERS`` fingerprints own is deep: its fingerprints go to pairs of
code words, the second of another block of 23 bits, and the bits that differ are shared out
between the blocks. Where an anchor or a pair still has more owners than that, owners are dealt
to slices and its guests go to all of them. So work at one place is bounded whatever the number
of fingerprints and however alike they are; the links found are the same either way.

Equal fingerprints are one node (pre-aggregated). Places are worked on many at a time, as arrays;
each answers with one link per fingerprint to the least one that it reaches there, not all pairs,
so copies never multiply.

Null text is empty: fingerprint zero, which links like any other. Rows with a null ``doc_id``
are fingerprinted and get the component of their fingerprint. Repeated rows each give a row; an
empty table gives an empty result. Texts are taken whole, however long, and columns besides
``doc_id`` and ``text`` are ignored (``keep_one`` keeps them, whatever their names).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_rank, texts
from .components import connected_components

THRESHOLD = 3
SHINGLE = 3
BLOCK = 23
#: Owners that an anchor, or a slice of one, should have at most.
OWNERS = 8192
#: Copies of fingerprints that one task should take, and pairs that it looks at together.
COPIES, PAIRS = 2_000_000, 2_000_000
#: Generator polynomial of the binary Golay code, a fixed value.
GOLAY = 0xAE3


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """All code words, and for each syndrome the one error pattern of three bits or fewer."""
    words = np.zeros(1, np.int64)
    for i in range(12):
        words = np.concatenate([words, words ^ (GOLAY << i)])
    errors = np.array(_patterns(3), np.int64)
    leaders = np.zeros(1 << 11, np.int64)
    leaders[syndrome(errors)] = errors
    return np.sort(words), leaders


@functools.cache
def _patterns(most: int) -> tuple[int, ...]:
    """Words of BLOCK bits with up to ``most`` bits set, by their number of bits."""
    out, last = [0], [(0, -1)]
    for _ in range(most):
        last = [(w | 1 << i, i) for w, at in last for i in range(at + 1, BLOCK)]
        out += [w for w, _ in last]
    return tuple(out)


def syndrome(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for i in range(BLOCK - 1, 10, -1):
        x ^= np.where(x >> i & 1, GOLAY << (i - 11), 0)
    return x


def anchor(block: np.ndarray) -> np.ndarray:
    """The nearest code word of each 23-bit word."""
    return block ^ golay()[1][syndrome(block)]


@functools.cache
def reach(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the errors that lead to an anchor which a word within ``threshold``
    bits could own, and how many bits that takes; rows padded with -1 and a weight of 99. All
    words of one syndrome have the same errors, as the code is linear."""
    patterns = np.array(_patterns(threshold), np.int64)
    weight = _popcount(patterns).astype(np.int64)
    leaders = golay()[1]
    found = []
    for leader in leaders:  # a word of this syndrome
        error = leader ^ anchor(leader ^ patterns)
        one, first = np.unique(error, return_index=True)  # patterns come by weight
        found.append((one, weight[first]))
    most = max(len(x) for x, _ in found)
    errors, weights = np.full((len(found), most), -1, np.int64), np.full((len(found), most), 99, np.int64)
    for i, (x, w) in enumerate(found):
        errors[i, : len(x)], weights[i, : len(x)] = x, w
    return errors, weights


def _blocks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BLOCK) - 1)
    return (fp & mask).astype(np.int64), (fp >> np.uint64(BLOCK) & mask).astype(np.int64)


#: Keys of pairs of code words have this bit set, and the second word BLOCK bits up.
_PAIR = 1 << 62


def _is_deep(low: np.ndarray, deep: np.ndarray) -> np.ndarray:
    """Which anchors of a block are in ``deep`` (sorted)."""
    if not len(deep):
        return np.zeros(low.shape, bool)
    return deep[np.minimum(np.searchsorted(deep, low), len(deep) - 1)] == low


def anchor_keys(fp: np.ndarray, deep: np.ndarray) -> np.ndarray:
    """The place that each fingerprint owns."""
    low, high = _blocks(fp)
    own = anchor(low)
    return np.where(_is_deep(own, deep), own | anchor(high) << BLOCK | _PAIR, own)


def replicas(fp: np.ndarray, deep: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the places that each row is sent to."""
    errors, weights = reach(threshold)
    low, high = _blocks(fp)
    s, t = syndrome(low), syndrome(high)
    keys, bits = low[:, None] ^ errors[s], weights[s]
    rows, at = np.nonzero(bits <= threshold)
    keys, bits = keys[rows, at], bits[rows, at]
    further = _is_deep(keys, deep)
    out = [(rows[~further], keys[~further])]
    own = np.flatnonzero(further)
    for k in range(0, len(own), 65_536):
        r = rows[own[k : k + 65_536]]
        more = bits[own[k : k + 65_536], None] + weights[t[r]]
        i, j = np.nonzero(more <= threshold)
        pair = keys[own[k : k + 65_536]][i] | (high[r[i]] ^ errors[t[r[i]], j]) << BLOCK | _PAIR
        out.append((r[i], pair))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 (seed 42) of each three-word shingle of a text, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= SHINGLE:
        return np.array([digest(b" ".join(parts), 42)], np.uint64)
    return np.fromiter((digest(b"%b %b %b" % x, 42) for x in zip(parts, parts[1:], parts[2:], strict=False)), np.uint64, len(parts) - SHINGLE + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if set in over half of the hashes; none: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, fp``: a hash of the text, and the fingerprint as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(t)) for t in b.column(1).to_pylist()], np.uint64)
            # Ids pass through as they are: pandas would make floats of ids beside a null.
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "digest", "fp"])

    held = texts(docs)
    return held.withColumn("digest", F.xxhash64("text")).mapInArrow(run, "doc_id long, digest long, fp long")


def _roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``parent`` (the least member of each set, for each element) with the sets of i and j united."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _slice_of(fp: np.ndarray) -> np.ndarray:
    """A number by which owners are dealt to slices."""
    h = fp * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(33)).astype(np.int64)


def group_links(place: np.ndarray, part: np.ndarray, parts: np.ndarray, fp: np.ndarray, deep: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among copies of fingerprints sent to places (each in so many parts, and one of
    them): from each that is linked at one of these places to the least one that it reaches."""
    order = np.lexsort((fp, part, place))
    place, part, parts, fp = place[order], part[order], parts[order], fp[order]
    nodes, node = np.unique(fp, return_inverse=True)
    first = np.ones(len(fp), bool)
    first[1:] = (place[1:] != place[:-1]) | (part[1:] != part[:-1])
    start = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    size = np.diff(np.append(start, len(fp)))
    owners = np.flatnonzero((anchor_keys(fp, deep) == place) & (_slice_of(fp) % parts == part))
    owners = owners[size[group[owners]] > 1]
    parent, pairs = np.arange(len(nodes)), size[group[owners]]
    edge = np.append(0, np.cumsum(pairs))
    at = 0
    while at < len(owners):
        end = max(at + 1, int(np.searchsorted(edge, edge[at] + PAIRS, "right")) - 1)
        n = pairs[at:end]
        i = np.repeat(owners[at:end], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[group[owners[at:end]]], n)
        near = np.flatnonzero(_popcount(fp[i] ^ fp[j]) <= threshold)
        parent = _roots(parent, node[i[near]], node[j[near]])
        at = end
    linked = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[linked], nodes[parent[linked]]


def _owned(distinct: DataFrame, deep: np.ndarray) -> DataFrame:
    """``place, n``: how many fingerprints own each place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            place, n = np.unique(anchor_keys(b["fp"].to_numpy().view(np.uint64), deep), return_counts=True)
            yield pd.DataFrame({"place": place, "n": n})

    return distinct.select("fp").mapInPandas(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``a, b`` of fingerprints (column ``fp``, distinct) that link: enough of them to make the
    components, all between fingerprints that are linked in fact or through others."""
    owned = _owned(distinct, np.zeros(0, np.int64)).collect()  # 4,096 rows at most
    deep = np.sort(np.array([r.place for r in owned if r.n > OWNERS], np.int64))
    copies = sum(r.n for r in owned) * (71 if not len(deep) else 303)
    buckets = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-copies // COPIES))
    many = _owned(distinct, deep).where(F.col("n") > OWNERS).select("place", F.ceil(F.col("n") / OWNERS).alias("parts"))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 4096):
                fp = b["fp"].to_numpy()[k : k + 4096].view(np.uint64)
                rows, places = replicas(fp, deep, threshold)
                order = np.argsort(places, kind="stable")
                rows, places = rows[order], places[order]
                cut = np.flatnonzero(np.diff(places)) + 1
                yield pd.DataFrame({"place": places[np.append(0, cut)], "fps": [fp[r].tobytes() for r in np.split(rows, cut)]})

    def compare(some: pd.DataFrame) -> pd.DataFrame:
        n = np.array([len(x) // 8 for x in some["fps"]])
        fp = np.frombuffer(b"".join(some["fps"]), np.uint64)
        place, part, parts = (np.repeat(some[c].to_numpy(), n) for c in ("place", "part", "parts"))
        a, b = group_links(place, part, parts, fp, deep, threshold)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = distinct.select("fp").mapInPandas(send, "place long, fps binary").join(many, "place", "left")
    sent = sent.withColumn("parts", F.coalesce("parts", F.lit(1))).select("place", "fps", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = sent.groupBy(F.pmod(F.xxhash64("place", "part"), F.lit(buckets)).alias("bucket"))
    return dealt.applyInPandas(compare, "a long, b long").distinct()


def _classes(marked: DataFrame, threshold: int) -> DataFrame:
    """``fp, node, class`` of every fingerprint: its least ``doc_id``, and the least fingerprint
    of its component."""
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = connected_components(links(nodes, threshold))
    return materialise(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("class")), "classes")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the smallest ``doc_id`` reachable by links.
    A component whose rows all have a null ``doc_id`` has a null ``component_id``."""
    marked = materialise(fingerprints(docs), "simhash")
    classes = _classes(marked, threshold)
    least = classes.groupBy("class").agg(F.min("node").alias("component_id"))
    known = classes.select("fp", "class").join(least, "class").select("fp", "component_id")
    return marked.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component stays, the one
    with the least ``doc_id`` (of different texts with this id the one of the least hash; of
    rows with the same id and text the one whose other columns have the least hash, and rows that
    tie in this too are alike). Rows with a null ``doc_id`` all stay."""
    marked = materialise(fingerprints(docs), "simhash").where("doc_id is not null")
    classes = _classes(marked, threshold).select("fp", "class")
    first = marked.join(classes, "fp").groupBy("class").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    stay = first.select(F.col("first.doc_id").alias("__a"), F.col("first.digest").alias("__b")).distinct()
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__all"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__digest"), row_rank(docs).alias("__rank"))
    kept = own.join(stay, (F.col("__id") == F.col("__a")) & (F.col("__digest") == F.col("__b")), "left_semi")
    kept = kept.groupBy("__id", "__digest").agg(F.min_by("__all", "__rank").alias("__all")).select("__all")
    kept = kept.unionByName(own.where("__id is null").select("__all"))
    return kept.select(*[F.col("__all").getField(c).alias(c) for c in docs.columns])
