"""Jaccard join of documents over word n-grams by PartEnum signatures.

A document's set holds the hashes of its distinct three-word shingles. Two sets link when their
Jaccard similarity is at least ``NUM / DEN``. Sets are dealt to bands of sizes; linked sets lie in
one band or in neighbouring ones, and the smaller set takes part in the larger one's band too. In a
band linked sets differ in at most k elements, so a domain cut into k // 2 + 1 parts has a part in
which they differ at most once, and of this part's two pieces one is alike. A signature is the hash
of what a set holds in a piece of a part (``PIECES - DIFFER`` of them): all choices are enumerated,
and linked sets have one in common. No link is lost, and sets that share a signature are candidates
only. Two pieces make a third fewer signatures than three, and sets with less in common meet.

Candidates are sifted by odd sketches: an array of bits, each turned over by every element that
falls on it. Two sketches differ in no more bits than their sets differ in elements, so sifting
loses no link either. What is left is compared element by element.

Equal sets are one node. The links between nodes only have to join the components. So each node is
first compared with one other: of the least nodes of its signatures the least that the sketches
let pass, which takes a pair for each node however large a group is. Nodes without one look for any
candidate; those that have none take no further part. Then, where a signature's nodes still are in
several components, nodes outside of the largest one look for a candidate in another component,
then for more, until no signature had to leave any out. A signature's nodes are dealt to slices,
and a node that many others are compared with is copied to many tasks. Joins of tables that grow
with the corpus are merge joins at all sizes, so that what a small run writes tells what a large
one does.

Null text is empty; texts without words have no shingles and link with nothing. With fewer than
three words the whole sequence is the one shingle. Rows with a null ``doc_id`` link and join others,
and get the least id of their component (null if it has none). Repeated rows each give a row. Other
columns are ignored. An empty table gives an empty result. Texts are taken whole.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import write_table
from .common import materialise, temporary, texts
from .components import connected_components
from .simhash import shingle_hashes

NUM, DEN = 90, 100
#: Upper over lower end of a band; parts' differing pieces, and pieces of a part.
RATIO, DIFFER, PIECES = 1.5, 1, 2
#: Bits of a sketch for each element that sets of a band may differ in.
SKETCH_BITS = 8
#: Nodes of a signature that one slice should have, and rows that one task should take.
SLICE, TASK_ROWS = 4096, 400_000
#: Candidates that a node looks for in the first round, by how much more it does in the next, and
#: pairs that share a copy of a node.
FIRST, MORE, SHARE = 1, 8, 1000
#: Shingles whose signatures are made together, and pairs of sketches looked at together.
SLICE_SHINGLES, PAIRS = 1_000_000, 2_000_000
MARKED = "doc_id long, digest long, row long, n long, key binary, band int, sketch array<long>, signatures array<long>"


def shingle_set(text: str) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes."""
    return np.unique(shingle_hashes(text))


def most_apart(a, b, num: int = NUM, den: int = DEN):
    """In how many elements linked sets of these sizes may differ."""
    return (a + b) * (den - num) // (den + num)


@functools.cache
def edges(num: int, den: int) -> list[int]:
    """Lower ends of the bands: sets of the first one link with equal sets only."""
    ratio = max(RATIO, den / num)
    first = -(-(den + num) // (2 * (den - num))) if num < den else 1 << 40
    out = [1, max(2, first)]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


def band_of(size: int, num: int = NUM, den: int = DEN) -> int:
    return bisect.bisect_right(edges(num, den), size) - 1


def spread(x: np.ndarray, seed: int) -> np.ndarray:
    """A mixing function of 64 bits."""
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def shape(band: int, num: int, den: int) -> tuple[int, int, tuple[tuple[int, ...], ...], int]:
    """Parts, pieces of a part, the choices of pieces, and bits of a sketch in a band."""
    largest = edges(num, den)[band + 1] - 1
    k = most_apart(largest, largest, num, den)
    differ = min(DIFFER, k)
    pieces = PIECES if differ else 1
    return k // (differ + 1) + 1, pieces, tuple(combinations(range(pieces), pieces - differ)), -(-SKETCH_BITS * max(k, 1) // 64) * 64


def signatures(sets: list[np.ndarray], band: int, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """A row of signatures, and one of the sketch's bits, for each of the sets."""
    parts, pieces, choices, bits = shape(band, num, den)
    size = np.array([len(s) for s in sets])
    owner, h = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    at = ((spread(h, 1) >> np.uint64(32)) * np.uint64(parts * pieces) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(len(sets) * parts * pieces, np.uint64)
    np.add.at(sums, owner * (parts * pieces) + at, spread(h, 2))
    sums = sums.reshape(len(sets), parts, pieces)
    place = np.arange(parts * len(choices), dtype=np.uint64).reshape(parts, len(choices)) + np.uint64(band << 32)
    chosen = np.stack([sums[:, :, list(c)].sum(axis=2, dtype=np.uint64) for c in choices], axis=2)
    out = spread(chosen + spread(place, 3), 4).reshape(len(sets), -1)
    bit = (spread(h, 5) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(owner * bits + bit, minlength=len(sets) * bits) & 1
    packed = np.packbits(odd.astype(np.uint8).reshape(len(sets), bits), axis=1)
    return out.view(np.int64), packed.view(np.int64)


def mark(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """A row for each document and band that it takes part in (``band`` is null for one more row
    that stands for the document itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = b.column(1).to_pylist(), 0
            while at < len(rows):
                sets, size, start = [], 0, at
                while at < len(rows) and size < SLICE_SHINGLES:
                    sets.append(shingle_set(rows[at]))
                    size += len(sets[-1])
                    at += 1
                yield _marked(b.slice(start, at - start), sets, num, den)

    held = texts(docs).select("doc_id", "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"))
    return held.mapInArrow(run, MARKED)


def _marked(b: pa.RecordBatch, sets: list[np.ndarray], num: int, den: int) -> pa.RecordBatch:
    of_band: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for band in range(band_of(len(s), num, den), band_of(len(s) * den // num, num, den) + 1) if len(s) else ():
            if shape(band, num, den)[0] > 1 or shape(band, num, den)[1] > 1:
                of_band.setdefault(band, []).append(i)
    at, bands, sketches, found = list(range(len(sets))), [None] * len(sets), [None] * len(sets), [None] * len(sets)
    for band, own in of_band.items():
        rows, packed = signatures([sets[i] for i in own], band, num, den)
        at += own
        bands += [band] * len(own)
        sketches += list(packed)
        found += list(rows)
    keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    take = pa.array(at)
    columns = [
        b.column(0).take(take),
        b.column(2).take(take),
        b.column(3).take(take),
        pa.array([len(s) for s in sets], pa.int64()).take(take),
        pa.array(keys, pa.binary()).take(take),
        pa.array(bands, pa.int32()),
        pa.array(sketches, pa.list_(pa.int64())),
        pa.array(found, pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "row", "n", "key", "band", "sketch", "signatures"])


def _sets(docs: DataFrame, wanted: DataFrame, total_bytes: int) -> tuple[DataFrame, Callable[[], None]]:
    """``node, elements`` of the wanted nodes (``node, doc_id, digest``), from their texts, as a
    table bucketed by node, so that pairs find their sets without moving all of them; and what
    drops the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shingle_set(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["node", "elements"])

    own = texts(docs).withColumn("h", F.xxhash64("text"))
    wanted = wanted.withColumnRenamed("doc_id", "id").hint("merge")  # one plan at all sizes
    met = own.join(wanted, (F.col("h") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("id")))
    # Repeated rows give the same set again.
    found = met.select("node", "text").mapInArrow(run, "node long, elements binary").groupBy("node").agg(F.first("elements").alias("elements"))
    return write_table(found, total_bytes, "node")


def _alike(a: bytes, b: bytes, num: int, den: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets link. A ``b`` that many pairs have is copied, so
    that no task has more than ``SHARE`` pairs of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = pa.array([_alike(p, q, num, den) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("long").alias("shares"))
    one = pairs.join(many, "b").withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares"))).drop("shares")
    one = one.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
    other = sets.join(many.withColumnRenamed("b", "node"), "node").select(F.col("node").alias("b"), F.col("elements").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    return one.join(other, ["b", "share"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sift(n: np.ndarray, part: np.ndarray, sketch: np.ndarray, owner: np.ndarray, node: np.ndarray, most: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of the rows of a signature (``part`` is their component) up to ``most`` candidates in other
    components for each owner, and whether any owner had more."""
    order = np.argsort(node)
    own, found, more = order[owner[order]], np.zeros(len(order), np.int64), False
    left, right = [], []
    width = max(1, min(256, PAIRS // max(1, len(own))))
    for k in range(0, len(order), width):
        them = order[k : k + width]
        own = own[found[own] <= most]
        for j in range(0, len(own), max(1, PAIRS // width)):
            us = own[j : j + max(1, PAIRS // width)]
            apart = np.zeros((len(us), len(them)), np.int64)
            for w in range(sketch.shape[1]):
                apart += np.bitwise_count(sketch[us, w][:, None] ^ sketch[them, w][None, :])
            total = n[us][:, None] + n[them][None, :]
            # Of two owners the later one asks.
            ok = (np.maximum(apart, np.abs(n[us][:, None] - n[them][None, :])) <= total * (den - num) // (den + num)) & (part[us][:, None] != part[them][None, :])
            ok &= ~owner[them][None, :] | (node[them][None, :] < node[us][:, None])
            count = found[us][:, None] + np.cumsum(ok, axis=1)
            more |= bool((ok & (count > most)).any())
            i, j2 = np.nonzero(ok & (count <= most))
            left.append(us[i]), right.append(them[j2])
            found[us] = count[:, -1]
    return np.concatenate(left) if left else own[:0], np.concatenate(right) if right else own[:0], more


def _first_pairs(shared: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: for each node the least node that its signatures know and its sketch lets pass."""
    least = shared.groupBy("signature").agg(F.min("node").alias("b"))
    other = shared.select("signature", F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    hub = other.join(least, ["signature", "b"])
    met = shared.join(hub, "signature").where("node <> b")
    bits = F.aggregate(F.zip_with("sketch", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = F.greatest(bits, F.abs(F.col("n") - F.col("m"))) <= F.floor((F.col("n") + F.col("m")) * (den - num) / (den + num))
    return met.where(near).groupBy(F.col("node").alias("a")).agg(F.min("b").alias("b"))


def _partners(shared: DataFrame, first: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: for nodes that ``first`` says nothing of a candidate in each signature."""
    known = first.select(F.col("a").alias("node")).union(first.select("b")).distinct().withColumn("known", F.lit(True))
    held = shared.join(known.hint("merge"), "node", "left").withColumn("owner", F.col("known").isNull()).withColumn("component", F.col("node"))
    wide = held.groupBy("signature").agg(F.count_if("owner").alias("others")).where("others > 0")
    wide = wide.select("signature", F.ceil(F.col("others") / SLICE).cast("long").alias("slices"))
    return _compared(held.join(wide.hint("merge"), "signature"), shared.count(), 1, num, den).where("a is not null")


def _candidates(shared: DataFrame, component: DataFrame, most: int, num: int, den: int) -> DataFrame:
    """``a, b``: candidates of nodes in other components, ``most`` for each node and signature;
    with a null ``a`` the signatures (``b``) that had to leave some out."""
    held = shared.join(component.hint("merge"), "node")
    by = held.groupBy("signature", "component").agg(F.count("*").alias("c")).groupBy("signature")
    by = by.agg(F.count("*").alias("components"), F.max_by("component", F.struct("c", "component")).alias("main"), (F.sum("c") - F.max("c")).alias("others"))
    wide = by.where("components > 1").select("signature", "main", F.ceil(F.col("others") / SLICE).cast("long").alias("slices"))
    return _compared(held.join(wide.hint("merge"), "signature").withColumn("owner", F.col("component") != F.col("main")), shared.count(), most, num, den)


def _compared(held: DataFrame, rows: int, most: int, num: int, den: int) -> DataFrame:
    """Candidates among rows of ``signature, node, n, sketch, component``: each ``owner`` looks in
    one of the ``slices`` of its signature, among all rows of the signature. ``rows``: about how
    many there are."""
    held = held.withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")))
    dealt = held.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).withColumn("owner", F.col("owner") & (F.col("own") == F.col("slice")))
    dealt = dealt.select("signature", "slice", "node", "component", "n", "owner", "sketch")
    buckets = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))

    def compare(some: pd.DataFrame) -> pd.DataFrame:
        a, b, cut_off = [], [], []
        some = some.sort_values(["signature", "slice"], kind="stable")
        key = some[["signature", "slice"]].to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        node, n, part, owner, sketch = (some[c].to_numpy() for c in ("node", "n", "component", "owner", "sketch"))
        for low, high in zip([0, *cut], [*cut, len(some)], strict=True):
            at = slice(low, high)
            bits = np.stack(sketch[at]).view(np.uint64)
            i, j, more = sift(n[at], part[at], bits, owner[at].astype(bool), node[at], most, num, den)
            a.append(node[at][i]), b.append(node[at][j])
            if more:
                cut_off.append(key[low, 0])
        out = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates().astype({"a": "Int64", "b": "int64"})
        rest = pd.DataFrame({"a": pd.array([None] * len(cut_off), "Int64"), "b": np.array(cut_off, np.int64)})
        return pd.concat([out, rest]) if cut_off else out

    return dealt.groupBy(F.pmod(F.xxhash64("signature", "slice"), F.lit(buckets)).alias("bucket")).applyInPandas(compare, "a long, b long")


def _links(docs: DataFrame, marked: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` of nodes whose sets link: enough of the links to join the components."""
    spark = docs.sparkSession
    own = marked.where("band is not null").join(nodes.select("node").hint("merge"), F.col("row") == F.col("node"), "left_semi")
    own = materialise(own.select("row", "n", "band", "sketch", "signatures"), "own")
    sent = own.select(F.col("row").alias("node"), "band", F.explode("signatures").alias("signature"))
    often = sent.groupBy("signature").agg(F.count("*").alias("m")).where("m > 1").select("signature")
    marks = own.select(F.col("row").alias("node"), "band", "n", "sketch")
    shared = materialise(sent.join(often, "signature").join(marks, ["node", "band"]).select("signature", "node", "n", "sketch"), "shared")
    first = materialise(_first_pairs(shared, num, den), "first")
    pairs = materialise(first.unionByName(_partners(shared, first, num, den)).distinct(), "pairs")
    active = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "active")
    shared = materialise(shared.join(active.hint("merge"), "node", "left_semi"), "shared")
    ids = marked.where("band is null").select(F.col("row").alias("node"), "doc_id", "digest", "n").join(active.hint("merge"), "node", "left_semi")
    ids = materialise(ids, "ids")
    sets, drop = _sets(docs, ids.drop("n"), 8 * (ids.agg(F.sum("n")).first()[0] or 0))
    links, seen, most = materialise(verified(pairs, sets, num, den), "links"), pairs, FIRST
    while True:
        joined = connected_components(links)
        component = materialise(active.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "component")
        found = materialise(_candidates(shared, component, most, num, den), "candidates")
        fresh = materialise(found.where("a is not null").distinct().join(seen, ["a", "b"], "left_anti"), "fresh")
        links, seen = materialise(links.unionByName(verified(fresh, sets, num, den)), "links"), seen.unionByName(fresh)
        rest = found.where("a is null").select(F.col("b").alias("signature")).distinct()
        if rest.isEmpty():
            drop()
            return links
        # Other signatures have named all their candidates.
        shared, most = materialise(shared.join(rest, "signature", "left_semi"), "shared"), most * MORE


def classes(docs: DataFrame, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The marked rows; ``key, node, least`` of each distinct set (a row that has it, and the least
    ``doc_id`` that does); and links between nodes, ``a, b``, that join the components."""
    marked = materialise(mark(docs, num, den), "marked", keep=True)
    rows = marked.where("band is null and n > 0")
    nodes = materialise(rows.groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "nodes", keep=True)
    with temporary(docs.sparkSession):
        return marked, nodes, materialise(_links(docs, marked, nodes, num, den), "links", keep=True)


def components(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the size of its set and the smallest
    ``doc_id`` that links reach."""
    marked, nodes, links = classes(docs, num, den)
    found = connected_components(links).withColumnRenamed("component", "class")
    placed = materialise(nodes.join(found, "node", "left").select("key", "least", F.coalesce("class", "node").alias("class")), "classes")
    known = placed.select("key", "class").join(placed.groupBy("class").agg(F.min("least").alias("component")), "class").select("key", "component")
    rows = marked.where("band is null").select("doc_id", "n", "key").join(known, "key", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
