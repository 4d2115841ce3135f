"""Random forests of many bags, grown side by side.

Values become codes by quantiles, one byte each, once for all bags. Each iteration has its own
training rows, and each tree its own weights: how often a row is drawn comes from a hash of row,
iteration and tree, so no draw is written down. A task gets the rows of an iteration and some of
its trees, and grows these level by level, a few nodes at a time, so that what is held fits a
core's cache: nodes of many rows are split from counts of their codes, others from a sort of
them. Trees are tables of numbers, and rows are scored by all trees of their iteration in parts,
so neither forests nor rows come to the driver.

Nodes with more than ``LOCAL_ROWS`` rows are no task's work: their upper trees grow on the driver
from histograms, one aggregate of (tree, node, feature, code) for all open nodes of a level, until
every node left is small enough; then the rows of each such node go to a task that grows the rest.
Either way the same trees come out.

Splits are by Gini impurity among a random share of the features (all others, if these don't tell
rows apart), down to pure nodes or the greatest depth. Of equal splits the first feature in the
node's random order is taken, and of its codes the least. Null and NaN values count as greatest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import kept

#: Cut points of a feature; codes are a byte.
CUTS = 255
#: Trees that a task grows at a time, rows times trees it should have, and rows scored together.
TREES, ENTRIES, SCORED = 25, 4_000_000, 250_000
#: Rows that a task grows trees from (counts of both classes in one number are exact up to two
#: million), and open nodes whose histograms are made together.
LOCAL_ROWS, OPEN = 200_000, 1000
#: Rows from which a node is split from counts; entries times features, nodes whose features are
#: drawn, and rows that go through a tree, at a time: what they take fits a core's cache.
MANY, AT_ONCE, NODES, ABREAST = 400, 32_768, 4096, 16_384
#: Rows times trees that grow side by side in a task.
BESIDE = 200_000
KINDS = {"feature": np.int16, "code": np.uint8, "left": np.int32, "value": np.float64}
#: Trees as they are sent to those who score by them: values of leaves only, and no children, as
#: these stand in the order of their parents.
SENT = ("feature", "code", "value")
MODEL = "iteration int, part int, unit int, roots int, feature binary, code binary, value binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeded(*parts: int) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(p & 0xFFFFFFFFFFFFFFFF) + np.uint64(1))
    return h[0]


def times_drawn(row: np.ndarray, seed: np.uint64) -> np.ndarray:
    """How often each row is in a sample with replacement of as many rows: a Poisson number."""
    u = (mix(row ^ seed) >> np.uint64(11)).astype(np.float64) / 2.0**53
    chance = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
    return np.searchsorted(chance, u, "right")


#: What an entry carries, by twice its weight plus its class: the weight, and again in the upper half for ones.
CARRIED = np.array([(i >> 1) * (1 + ((i & 1) << 32)) for i in range(64)], np.int64)


def _sums(load: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and weights of ones that numbers of 64 bits carry in their halves."""
    halves = load.view(np.int32)
    return halves[..., 0::2].astype(np.float64), halves[..., 1::2].astype(np.float64)


def gain(left: np.ndarray, left1: np.ndarray, total: np.ndarray, total1: np.ndarray) -> np.ndarray:
    """What a split takes from Gini impurity, times the node's weight squared (a constant of it)."""
    apart = left1 * total
    apart -= left * total1
    apart *= apart
    apart /= np.maximum(left * (total - left), 1)
    return apart


def _first_best(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node the first feature (rows of ``most``) whose best split is as good as any, and
    the least score that counts as such: equal ones differ in the last digits."""
    best = most.max(axis=0)
    least = np.where(best >= 0, best * (1 - 1e-12), np.inf)
    return np.argmax(most >= least, axis=0), least


def _from_counts(flat: np.ndarray, start: np.ndarray, held: np.ndarray, size: np.ndarray, whole: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, ...]:
    """Best splits of nodes of many rows: weights are counted by code."""
    n, k = features.shape
    load, weight, step = np.zeros((k, n, 256), np.int64), CARRIED.take(held).astype(np.float64), max(1, AT_ONCE // 8)
    if n == 1:
        counts = np.zeros((k, 256))
        for low in range(0, len(start), step):
            at, w = start[low : low + step], weight[low : low + step]
            for j, f in enumerate(features[0]):
                counts[j] += np.bincount(flat.take(at + f), w, 256)
        load[:, 0] = counts
    else:
        node = np.repeat(np.arange(n), size)
        first = node << 8
        for j in range(k):
            load[j] = np.bincount(flat.take(start + features[:, j].take(node)) + first, weight, n * 256).reshape(n, 256)
    load = np.cumsum(load, axis=2)
    total, total1 = (x[:, None] for x in _sums(whole))
    left, left1 = _sums(load)
    score = gain(left, left1, total, total1)
    np.putmask(score, (left == 0) | (left == total), -1.0)
    j, least = _first_best(score.max(axis=2))
    every = np.arange(n)
    code = np.argmax(score[j, every] >= least[:, None], axis=1)
    found = least < np.inf
    return np.where(found, features[every, j], -1), np.where(found, code, -1), load[j, every, code]


def _from_order(flat: np.ndarray, start: np.ndarray, held: np.ndarray, size: np.ndarray, whole: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, ...]:
    """Best splits of nodes of few rows: for each of their features one sort of numbers of node,
    code and what the entry carries."""
    n, k = features.shape
    node = np.repeat(np.arange(n), size)
    place = features.T.take(node, axis=1)
    place += start
    key = flat.take(place).astype(np.uint32)
    key <<= np.uint32(6)
    key |= (node << 14).astype(np.uint32) | held.astype(np.uint32)
    key.sort(axis=1)
    load = np.cumsum(CARRIED.take(key & np.uint32(63)), axis=1)
    load -= np.repeat(np.cumsum(whole) - whole, size)
    total, total1 = (np.repeat(x, size) for x in _sums(whole))
    score = gain(*_sums(load), total, total1)
    # A split is a place where the code changes within a node.
    key >>= np.uint32(6)
    np.putmask(score[:, :-1], key[:, 1:] == key[:, :-1], -1.0)
    end = np.cumsum(size)
    score[:, end - 1] = -1.0
    j, least = _first_best(np.maximum.reduceat(score, end - size, axis=1))
    own = np.repeat(j * len(start), size) + np.arange(len(start))
    good = np.flatnonzero(score.ravel().take(own) >= np.repeat(least, size))
    at = node[good]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    good, at = own[good[first]], at[first]
    feature, code, left = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    feature[at], code[at], left[at] = features[at, j[at]], key.ravel()[good] & 255, load.ravel()[good]
    return feature, code, left


def _splits(flat: np.ndarray, entry: np.ndarray, size: np.ndarray, whole: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, ...]:
    """Best splits of nodes whose entries stand one node after the other, and what goes left. An
    entry is the place of its row's codes, times 64, plus twice the weight plus the class. A few
    nodes at a time, so that what is held fits a core's cache."""
    n, k = features.shape
    feature, code, left = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    many = size >= MANY
    for find, kind in ((_from_counts, many), (_from_order, ~many)):
        nodes = np.flatnonzero(kind)
        own = entry if len(nodes) == n else entry[np.repeat(kind, size)]
        sizes, end = size[nodes], np.cumsum(size[nodes])
        low = at = 0
        while low < len(nodes):
            high = max(low + 1, int(np.searchsorted(end, at + AT_ONCE // k, "right")))
            e, some = own[at : end[high - 1]], nodes[low:high]
            feature[some], code[some], left[some] = find(flat, e >> 6, e & 63, sizes[low:high], whole[some], features[some])
            low, at = high, int(end[high - 1])
    return feature, code, left


def best_splits(codes: np.ndarray, y: np.ndarray, row: np.ndarray, w: np.ndarray, slot: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node (``slot`` of each entry) the feature among its ``features`` and the code at
    which to split, -1 if none tells its rows apart. An entry is a row with a weight below 32."""
    order, n = np.argsort(slot, kind="stable"), len(features)
    held = w[order].astype(np.int64) << 1 | y[row[order]].astype(np.int64)
    size, whole = np.bincount(slot, minlength=n), np.bincount(slot[order], CARRIED.take(held), n).astype(np.int64)
    feature, code = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    some = np.flatnonzero(size)
    feature[some], code[some], _ = _splits(codes.ravel(), row[order] * codes.shape[1] << 6 | held, size[some], whole[some], features[some])
    return feature, code


def feature_order(uid: np.ndarray, n: int) -> np.ndarray:
    """All features in the random order of each node: the lowest bits of a hash give way to the
    feature, so numbers are sorted."""
    mask, every = np.uint64((1 << n.bit_length()) - 1), np.arange(n, dtype=np.uint64)
    key = mix(uid[:, None] ^ mix(every + np.uint64(1))[None, :])
    key = np.sort(key & ~mask | every, axis=1)
    return (key & mask).astype(np.int64)


def children(uid: np.ndarray) -> np.ndarray:
    """Left and right child of each node, side by side."""
    return mix(np.repeat(uid, 2) + np.tile(np.array([1, 2], np.uint64), len(uid)))


def _mixed(load: np.ndarray) -> np.ndarray:
    """Whether nodes have rows of both classes."""
    total, ones = _sums(load)
    return (ones > 0) & (ones < total)


def _dealt(flat: np.ndarray, entry: np.ndarray, size: np.ndarray, feature: np.ndarray, code: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of nodes that are split, and how many there are, by child, of children
    ``wanted`` (left and right one side by side): those that go right come after the others."""
    entries, sizes, ends, low, at = [entry[:0]], [size[:0]], np.cumsum(size), 0, 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(ends, at + AT_ONCE // 2, "right")))
        e, n = entry[at : ends[high - 1]], size[low:high]
        right = flat.take((e >> 6) + np.repeat(feature[low:high], n)) > np.repeat(code[low:high], n)
        rank, end = np.cumsum(right), np.cumsum(n)
        last = rank[end - 1]
        own = np.diff(last, prepend=0)
        moved = np.empty_like(e)
        moved[np.where(right, rank + np.repeat(end - last - 1, n), np.arange(len(e)) - rank + np.repeat(last - own, n))] = e
        child, keep = np.stack([n - own, own], axis=1).ravel(), wanted[2 * low : 2 * high]
        entries.append(moved if keep.all() else moved[np.repeat(keep, child)])
        sizes.append(child[keep])
        low, at = high, int(ends[high - 1])
    return np.concatenate(entries), np.concatenate(sizes)


def grow(codes: np.ndarray, y: np.ndarray, ids: np.ndarray, trees: list[np.uint64], depth: int, share: int, uid: np.ndarray | None = None, level: int = 0) -> dict[str, np.ndarray]:
    """The trees of the given seeds over rows: of each node the feature and code (rows with a
    greater code go right), its left child (the right one is next to it) and its part of ones;
    ``feature`` is -1 for leaves. With ``uid`` and ``level`` of a node only what is below it."""
    flat, width = np.ascontiguousarray(codes).ravel(), codes.shape[1]
    drawn = [times_drawn(ids, s) for s in trees]
    held = [w << 1 | y.astype(np.int64) for w in drawn]
    rows = [np.flatnonzero(w) for w in drawn]
    # Entries of the nodes that may be split stand one node after the other.
    entry = np.concatenate([r * width << 6 | h[r] for r, h in zip(rows, held, strict=True)])
    size, load = np.array([len(r) for r in rows]), np.array([CARRIED.take(h).sum() for h in held])
    wanted = _mixed(load) & (level < depth)
    entry, size = entry[np.repeat(wanted, size)], size[wanted]
    uid = np.array(trees, np.uint64) if uid is None else uid
    out: dict[str, list[np.ndarray]] = {c: [] for c in KINDS}
    base = 0
    for level in range(level, depth + 1):
        n = len(uid)
        total, ones = _sums(load)
        open_ = np.flatnonzero(wanted)
        feature, code, left = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        ends = np.cumsum(size)
        for low in range(0, len(open_), NODES):
            some = open_[low : low + NODES]
            sizes, e = size[low : low + NODES], entry[ends[low] - size[low] : ends[low + len(some) - 1]]
            order = feature_order(uid[some], width)
            f, c, to_left = _splits(flat, e, sizes, load[some], order[:, :share])
            none = np.flatnonzero(f < 0)
            if len(none) and share < width:
                f[none], c[none], to_left[none] = _splits(flat, e[np.repeat(f < 0, sizes)], sizes[none], load[some[none]], order[none, share:])
            feature[some], code[some], left[some] = f, c, to_left
        split = np.flatnonzero(feature >= 0)
        child = np.full(n, -1, np.int64)
        child[split] = 2 * np.arange(len(split))
        out["feature"].append(feature), out["code"].append(np.maximum(code, 0))
        out["left"].append(np.where(child >= 0, base + n + child, 0))
        out["value"].append(np.divide(ones, total, out=np.zeros(n), where=total > 0))
        base += n
        if not len(split):
            break
        if len(split) < len(open_):
            entry, size = entry[np.repeat(feature[open_] >= 0, size)], size[feature[open_] >= 0]
        load, uid = np.stack([left[split], load[split] - left[split]], axis=1).ravel(), children(uid[split])
        wanted = _mixed(load) & (level + 1 < depth)
        entry, size = _dealt(flat, entry, size, feature[split], code[split], wanted)
    return {c: np.concatenate(v) for c, v in out.items()}


def steps(model: dict[str, np.ndarray]) -> np.ndarray:
    """A number for each node: its left child, feature and code. A leaf is its own left child."""
    inner = model["feature"] >= 0
    left = np.where(inner, model["left"], np.arange(len(inner))).astype(np.int64)
    return left << 24 | np.where(inner, model["feature"], 0).astype(np.int64) << 8 | np.where(inner, model["code"], 255)


def landed(table: np.ndarray, node: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The leaf that each row comes to in each tree, from its root (``node``: tree, row), by the
    ``steps`` of a model."""
    out, flat, width = node.ravel(), np.ascontiguousarray(codes).ravel(), codes.shape[1]
    on, here, start = None, out, np.tile(np.arange(len(codes)) * width, len(node))
    while len(here):
        step = table.take(here)
        code = flat.take(start + (step >> 8 & 0xFFFF))
        to = (step >> 24) + (code > (step & 255))
        moved = to != here
        here = to
        if 4 * np.count_nonzero(moved) < 3 * len(here):  # those at a leaf are done
            still = np.flatnonzero(moved)
            if on is None:
                out = here.copy()
            else:
                out[on] = here
            on, here, start = still if on is None else on[still], here[still], start[still]
    return out.reshape(node.shape)


def predicted(model: dict[str, np.ndarray], trees: int, codes: np.ndarray) -> np.ndarray:
    """The sum over trees of the part of ones in the leaf of each row."""
    table, out = steps(model), np.zeros(len(codes))
    for low in range(0, len(codes), ABREAST):
        some = np.ascontiguousarray(codes[low : low + ABREAST])
        together = max(1, ABREAST // len(some))
        for first in range(0, trees, together):
            roots = np.arange(first, min(trees, first + together))
            leaves = landed(table, np.repeat(roots[:, None], len(some), axis=1), some)
            out[low : low + len(some)] += model["value"].take(leaves).sum(axis=0)
    return out


def cut_points(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """Sorted cut points of each column, values of its own at even quantiles."""
    found = rows.approxQuantile(columns, [(i + 1) / (CUTS + 1) for i in range(CUTS)], 0.25 / CUTS)
    return [sorted(set(c)) for c in found]


def coded(rows: DataFrame, columns: list[str], cuts: list[list[float]], key: str) -> DataFrame:
    """``key, row, codes``: a hash of the key, and a byte per column, the number of cut points
    below the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [b.column(i + 2).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(columns))]
            out = np.empty((b.num_rows, len(columns)), np.uint8)
            for i, c in enumerate(cuts):
                out[:, i] = np.searchsorted(np.array(c), x[i])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in out], pa.binary())], names=[key, "row", "codes"])

    held = rows.select(key, F.xxhash64(key).alias("row"), *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(columns)])
    return held.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, row long, codes binary")


def _matrix(codes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of bytes, all of one length, as a matrix."""
    parts = [c for c in (codes.chunks if isinstance(codes, pa.ChunkedArray) else [codes]) if len(c)]
    if not parts:
        return np.empty((0, 0), np.uint8)
    out = []
    for c in parts:
        large = pa.types.is_large_binary(c.type)
        ends = np.frombuffer(c.buffers()[1], np.int64 if large else np.int32)[c.offset : c.offset + len(c) + 1]
        out.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(c), -1))
    return out[0] if len(out) == 1 else np.concatenate(out)


def _rows(models: list[tuple[int, int, int, int, dict[str, np.ndarray]]]) -> pa.Table:
    """A row of ``MODEL`` for each (iteration, part, unit, roots, trees)."""
    columns = [pa.array([m[i] for m in models], pa.int32()) for i in range(4)]
    sent = [m[4] | {"value": m[4]["value"][m[4]["feature"] < 0]} for m in models]
    columns += [pa.array([m[c].astype(KINDS[c]).tobytes() for m in sent], pa.binary()) for c in SENT]
    return pa.table(columns, names=["iteration", "part", "unit", "roots", *SENT])


def _model(m: dict) -> dict[str, np.ndarray]:
    """The trees of a row of ``MODEL``."""
    out = {c: np.frombuffer(m[c], KINDS[c]) for c in SENT}
    inner = out["feature"] >= 0
    value = np.zeros(len(inner))
    value[~inner] = out["value"]
    return out | {"value": value, "left": np.where(inner, m["roots"] + 2 * (np.cumsum(inner) - 1), 0)}


def _learned(some: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, classes and hashes of the rows of a task."""
    return _matrix(some["codes"]), some["y"].to_numpy().astype(np.float64), some["row"].to_numpy().view(np.uint64)


def _share(features: int) -> int:
    return max(1, math.isqrt(features))


@dataclass
class Top:
    """The upper part of a tree. ``state`` of a node: split or leaf (``DONE``), in need of a
    histogram of its first or of its other features, or left to a task (``UNIT``)."""

    uid: list[int]
    level: list[int]
    state: list[int]
    feature: list[int]
    code: list[int]
    left: list[int]
    value: list[float]

    def add(self, uid: int, level: int, state: int, value: float) -> None:
        for held, v in zip((self.uid, self.level, self.state, self.feature, self.code, self.left, self.value), (uid, level, state, -1, 0, 0, value), strict=True):
            held.append(v)

    def arrays(self) -> dict[str, np.ndarray]:
        return {c: np.array(getattr(self, c), k) for c, k in KINDS.items()}


DONE, FIRST, OTHERS, UNIT = range(4)
Tops = dict[tuple[int, int], Top]


def _state(n0: float, n1: float, level: int, depth: int) -> int:
    if not n0 or not n1 or level >= depth:
        return DONE
    return FIRST if n0 + n1 > LOCAL_ROWS else UNIT


def _histograms(rows: DataFrame, tops: Tops, some: list[tuple[int, int, int]], seed: int) -> DataFrame:
    """``iteration, tree, node, j, code, n0, n1`` of open nodes: weights of both classes by the
    code of the j-th feature in the node's order."""
    send: dict[int, list] = {}
    for (i, t), nodes in _by_tree(some).items():
        top = tops[i, t]
        send.setdefault(i, []).append((t, steps(top.arrays()), nodes, np.array([top.uid[n] for n in nodes], np.uint64), np.array([top.state[n] == OTHERS for n in nodes])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            iteration, every = b.column("iteration").to_numpy(), _matrix(b.column("codes"))
            for i in np.unique(iteration):
                own = iteration == i
                codes, ids, y = every[own], b.column("row").to_numpy()[own].view(np.uint64), b.column("y").to_numpy()[own].astype(np.float64)
                n = codes.shape[1]
                for t, top, nodes, uid, others in send.get(int(i), ()):
                    w = times_drawn(ids, _seeded(seed, int(i), t))
                    e = np.flatnonzero(w)
                    slot = np.full(len(top), -1, np.int64)
                    slot[nodes] = np.arange(len(nodes))
                    at = slot[landed(top, np.zeros((1, len(e)), np.int64), codes[e])[0]]
                    e, at = e[at >= 0], at[at >= 0]
                    order, place = feature_order(uid, n), np.arange(n)
                    use = np.where(others[:, None], place >= _share(n), place < _share(n))
                    key = ((at[:, None] * n + place) * 256 + codes[e[:, None], order[at]])[use[at]]
                    weight, one = np.repeat(w[e].astype(np.float64), use[at].sum(axis=1)), np.repeat(y[e], use[at].sum(axis=1))
                    part = np.stack([np.bincount(key, weight * (1 - one), len(nodes) * n * 256), np.bincount(key, weight * one, len(nodes) * n * 256)]).astype(np.float64)
                    sums[int(i), t] = sums.get((int(i), t), 0) + part
        for i, trees in send.items():
            for t, _, nodes, *_ in trees:
                if (i, t) in sums:
                    part = sums[i, t]
                    key = np.flatnonzero(part.sum(axis=0))
                    group, n = key >> 8, part.shape[1] // 256 // len(nodes)
                    columns = [np.full(len(key), i, np.int32), np.full(len(key), t, np.int32), np.array(nodes, np.int32)[group // n], (group % n).astype(np.int32), (key & 255).astype(np.int32), part[0, key], part[1, key]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["iteration", "tree", "node", "j", "code", "n0", "n1"])

    found = rows.select("iteration", "row", "y", "codes").mapInArrow(run, "iteration int, tree int, node int, j int, code int, n0 double, n1 double")
    return found.groupBy("iteration", "tree", "node", "j", "code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _by_tree(some: list[tuple[int, int, int]]) -> dict[tuple[int, int], list[int]]:
    out: dict[tuple[int, int], list[int]] = {}
    for i, t, n in some:
        out.setdefault((i, t), []).append(n)
    return out


def _best(some: pd.DataFrame) -> pd.DataFrame:
    """The best split of a node from its histogram; ``j`` is -1 if there is none."""
    some = some.sort_values(["j", "code"])
    j, code, n0, n1 = (some[c].to_numpy() for c in ("j", "code", "n0", "n1"))
    first = np.searchsorted(j, j)
    last = np.searchsorted(j, j, "right") - 1
    c0, c1 = np.cumsum(n0), np.cumsum(n1)
    l0, l1 = c0 - np.where(first > 0, c0[first - 1], 0), c1 - np.where(first > 0, c1[first - 1], 0)
    t0, t1 = l0[last], l1[last]
    out = {"iteration": some["iteration"].iloc[0], "tree": some["tree"].iloc[0], "node": some["node"].iloc[0], "j": -1, "code": 0, "l0": 0.0, "l1": 0.0, "t0": t0[0], "t1": t1[0]}
    at = np.flatnonzero(np.arange(len(j)) < last)
    if len(at):
        score = gain((l0 + l1)[at], l1[at], (t0 + t1)[at], t1[at])
        k = at[np.flatnonzero(score >= score.max() * (1 - 1e-12))[0]]
        out |= {"j": j[k], "code": code[k], "l0": l0[k], "l1": l1[k]}
    return pd.DataFrame([out])


def grow_tops(rows: DataFrame, iterations: list[int], trees: int, depth: int, seed: int, features: int) -> Tops:
    """The upper parts of all trees, down to nodes that a task can take."""
    tops: Tops = {}
    for i in iterations:
        for t in range(trees):
            tops[i, t] = Top([], [], [], [], [], [], [])
            tops[i, t].add(int(_seeded(seed, i, t)), 0, FIRST if depth else DONE, 0.0)
    open_ = [(i, t, 0) for i, t in tops]
    while open_:
        some, open_ = open_[:OPEN], open_[OPEN:]
        best = _histograms(rows, tops, some, seed).groupBy("iteration", "tree", "node").applyInPandas(_best, "iteration int, tree int, node int, j int, code int, l0 double, l1 double, t0 double, t1 double")
        for r in best.collect():  # a row for each open node
            top = tops[r.iteration, r.tree]
            top.value[r.node] = r.t1 / (r.t0 + r.t1)
            if not r.t0 or not r.t1 or r.j < 0:
                again = r.j < 0 and r.t0 and r.t1 and top.state[r.node] == FIRST and features > _share(features)
                top.state[r.node] = OTHERS if again else DONE
                open_ += [(r.iteration, r.tree, r.node)] * bool(again)
                continue
            uid, level, at = np.array([top.uid[r.node]], np.uint64), top.level[r.node] + 1, len(top.uid)
            top.state[r.node], top.feature[r.node], top.code[r.node], top.left[r.node] = DONE, int(feature_order(uid, features)[0, r.j]), r.code, at
            for side, n0, n1 in zip(children(uid), (r.l0, r.t0 - r.l0), (r.l1, r.t1 - r.l1), strict=True):
                top.add(int(side), level, _state(n0, n1, level, depth), n1 / (n0 + n1))
            open_ += [(r.iteration, r.tree, n) for n in (at, at + 1) if top.state[n] == FIRST]
    return tops


def _routed(rows: DataFrame, tops: Tops, names: list[str], drawn_seed: int | None) -> DataFrame:
    """Rows (``iteration, codes`` and columns named) with each ``tree`` and the ``unit`` of it
    that they come to, or the ``value`` of the leaf (``unit`` is -1). With a seed only the rows
    that a tree has drawn."""
    held = {key: (steps(top.arrays()), np.array(top.state), np.array(top.value)) for key, top in tops.items()}
    kept_names = ["iteration", *names, "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, iteration = _matrix(b.column("codes")), b.column("iteration").to_numpy()
            ids = b.column("row").to_numpy().view(np.uint64) if drawn_seed is not None else None
            for (i, t), (top, state, value) in held.items():
                e = np.flatnonzero(iteration == i)
                if ids is not None:
                    e = e[times_drawn(ids[e], _seeded(drawn_seed, i, t)) > 0]
                if len(e):
                    node = landed(top, np.zeros((1, len(e)), np.int64), codes[e])[0]
                    unit = np.where(state[node] == UNIT, node, -1).astype(np.int32)
                    columns = [*[b.column(c).take(pa.array(e)) for c in kept_names], pa.array(np.full(len(e), t, np.int32)), pa.array(unit), pa.array(value[node])]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept_names, "part", "unit", "value"])

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in kept_names], "part int", "unit int", "value double"])
    return rows.select(*kept_names).mapInArrow(run, schema)


@dataclass
class Forests:
    """``models`` of parts of an iteration's trees, or of the units below ``tops``, a tree each."""

    models: DataFrame
    trees: int
    iterations: int
    tops: Tops | None = None


def train(rows: DataFrame, trees: int, depth: int, seed: int, size: int, iterations: int, features: int) -> Forests:
    """Forests of ``rows (iteration, row, y, codes)``, one for each iteration from 0. ``size``:
    rows of an iteration."""
    if size > LOCAL_ROWS:
        return _train_below(rows, trees, depth, seed, iterations, features)
    step = max(1, min(TREES, ENTRIES // max(1, size)))
    parts = -(-trees // step)

    def run(some: pa.Table) -> pa.Table:
        iteration, part = some["iteration"][0].as_py(), some["part"][0].as_py()
        codes, y, ids = _learned(some)
        beside, out = max(1, BESIDE // len(y)), []
        for first in range(part * step, min(trees, (part + 1) * step), beside):
            seeds = [_seeded(seed, iteration, t) for t in range(first, min(trees, (part + 1) * step, first + beside))]
            out.append((iteration, part, -1, len(seeds), grow(codes, y, ids, seeds, depth, _share(features))))
        return _rows(out)

    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = dealt.withColumn("task", F.col("iteration") * parts + F.col("part")).repartitionById(iterations * parts, "task")
    return Forests(kept(dealt.groupBy("task").applyInArrow(run, MODEL)), trees, iterations)


def _train_below(rows: DataFrame, trees: int, depth: int, seed: int, iterations: int, features: int) -> Forests:
    rows = kept(rows)
    tops = grow_tops(rows, list(range(iterations)), trees, depth, seed, features)
    roots = {(i, t, n): (top.uid[n], top.level[n]) for (i, t), top in tops.items() for n, s in enumerate(top.state) if s == UNIT}

    def run(some: pa.Table) -> pa.Table:
        i, t, unit = (some[c][0].as_py() for c in ("iteration", "part", "unit"))
        uid, level = roots[i, t, unit]
        codes, y, ids = _learned(some)
        return _rows([(i, t, unit, 1, grow(codes, y, ids, [_seeded(seed, i, t)], depth, _share(features), np.array([uid], np.uint64), level))])

    units = _routed(rows, tops, ["row", "y"], seed).where("unit >= 0")
    return Forests(kept(units.groupBy("iteration", "part", "unit").applyInArrow(run, MODEL)), trees, iterations, tops)


def score(rows: DataFrame, forests: Forests, key: str, total: int) -> DataFrame:
    """``key, iteration, p``: rows (``key, iteration, codes``) by the forest of their iteration.
    ``total``: about how many rows there are of an iteration."""
    shares, kind = max(1, -(-total // SCORED)), dict(rows.dtypes)[key]

    def run(rows: pa.Table, models: pa.Table) -> pa.Table:
        if not len(models):
            rows = rows.slice(0, 0)
        codes, p = _matrix(rows["codes"]), np.zeros(len(rows))
        if len(rows):
            for m in models.to_batches(max_chunksize=1):
                for own in m.to_pylist():
                    p += predicted(_model(own), own["roots"], codes)
        return rows.select([key, "iteration"]).append_column("p", pa.array(p))

    places, rest = ["task"], None
    if forests.tops is not None:
        routed = _routed(rows, forests.tops, [key], None)
        places, rows = ["iteration", "part", "unit", "share"], routed.where("unit >= 0")
        rest = routed.where("unit < 0").select(key, "iteration", F.col("value").alias("p"))
    own = rows.withColumn("share", F.pmod(F.xxhash64(key), F.lit(shares)).cast("int"))
    each = forests.models.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    if forests.tops is None:  # a task for each iteration and share
        own, each = (x.withColumn("task", F.col("iteration") * shares + F.col("share")).repartitionById(forests.iterations * shares, "task") for x in (own, each))
    found = own.groupBy(*places).cogroup(each.groupBy(*places)).applyInArrow(run, f"`{key}` {kind}, iteration int, p double")
    if rest is not None:
        found = found.unionByName(rest).groupBy(key, "iteration").agg(F.sum("p").alias("p"))
    return found.withColumn("p", F.col("p") / forests.trees)
