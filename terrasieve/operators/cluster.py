"""k-means on plane points, and balance of classes per cluster."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import nearest_centre
from .running import running_totals
from .scratch import kept


def centroids(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("k").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"), F.sum("d2").alias("inertia"))


def lloyd_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``k, cx, cy, n, inertia`` after one step; a centre without points stays where it was."""
    moved = centroids(nearest_centre(points, centres)).withColumnsRenamed({"cx": "mx", "cy": "my"})
    out = centres.join(F.broadcast(moved), "k", "left")  # a row per centre
    return out.select("k", F.coalesce("mx", "cx").alias("cx"), F.coalesce("my", "cy").alias("cy"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("inertia", F.lit(0.0)).alias("inertia"))


Places = list[tuple[float, float]]
#: Points that a task packs together, points of a cell, and distances that it looks at together.
PACK, CELL, DISTANCES = 1 << 18, 32, 500_000


@dataclass
class Cells:
    """Points sorted by the cells of a grid that suits them; of each cell its points' mean, their
    squared distances from it in total, and the greatest distance of one."""

    x: np.ndarray
    y: np.ndarray
    start: np.ndarray
    n: np.ndarray
    mx: np.ndarray
    my: np.ndarray
    scatter: np.ndarray
    radius: np.ndarray


def pack(x: np.ndarray, y: np.ndarray) -> Cells:
    side = max(1, int(math.sqrt(len(x) / CELL)))
    place = lambda v: np.minimum(((v - v.min()) / (float(np.ptp(v)) or 1.0) * side).astype(np.int64), side - 1)
    cell = place(x) * side + place(y)
    order = np.argsort(cell, kind="stable")
    x, y, cell = x[order], y[order], cell[order]
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    n = np.diff(np.append(start, len(x)))
    mx, my = np.add.reduceat(x, start) / n, np.add.reduceat(y, start) / n
    d2 = (x - np.repeat(mx, n)) ** 2 + (y - np.repeat(my, n)) ** 2
    return Cells(x, y, start, n, mx, my, np.add.reduceat(d2, start), np.sqrt(np.maximum.reduceat(d2, start)))


def run_sums(cells: Cells, centres: np.ndarray) -> np.ndarray:
    """For centres of runs (run, k, 2) the number of points nearest to each, the sums of their
    places and of their squared distances (run, k, 4). A cell whose every point must be nearest to
    one centre, by the triangle inequality, counts as a whole; others count point by point."""
    runs, k, _ = centres.shape
    out = np.zeros((runs, k, 4))
    step = max(1, DISTANCES // max(1, len(cells.n) * k))
    for low in range(0, runs, step):
        some = centres[low : low + step]
        d2 = (cells.mx[:, None, None] - some[None, :, :, 0]) ** 2 + (cells.my[:, None, None] - some[None, :, :, 1]) ** 2
        own = d2.argmin(axis=2)
        near = np.sqrt(np.sort(d2, axis=2)[:, :, :2])
        gap = near[:, :, 1] - near[:, :, 0] if k > 1 else np.full(own.shape, np.inf)
        whole = gap > 2 * cells.radius[:, None] * (1 + 1e-9) + 1e-9 * near[:, :, -1]
        c, r = np.nonzero(whole)
        at, n = r * k + own[c, r], cells.n[c]
        values = (n, n * cells.mx[c], n * cells.my[c], cells.scatter[c] + n * d2[c, r, own[c, r]])
        part = np.stack([np.bincount(at, v, len(some) * k) for v in values], axis=1).astype(np.float64)
        c, r = np.nonzero(~whole)
        edge = np.cumsum(cells.n[c])
        cut = 0
        while cut < len(c):  # cells of a bounded number of points at a time
            stop = max(cut + 1, int(np.searchsorted(edge, (edge[cut - 1] if cut else 0) + DISTANCES // k, "right")))
            n = cells.n[c[cut:stop]]
            i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cells.start[c[cut:stop]], n)
            run = np.repeat(r[cut:stop], n)
            d = (cells.x[i][:, None] - some[run, :, 0]) ** 2 + (cells.y[i][:, None] - some[run, :, 1]) ** 2
            best = d.argmin(axis=1)
            at = run * k + best
            values = (None, cells.x[i], cells.y[i], d[np.arange(len(i)), best])
            part += np.stack([np.bincount(at, v, len(some) * k) for v in values], axis=1)
            cut = stop
        out[low : low + len(some)] = part.reshape(len(some), k, 4)
    return out


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and places of a task's points, many at a time."""
    held, size = [], 0
    for b in batches:
        held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        size += b.num_rows
        if size >= PACK:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _places(points: DataFrame) -> DataFrame:
    held = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return held.where("id is not null and x is not null and y is not null")


def _step(points: DataFrame, runs: dict[int, Places]) -> dict[tuple[int, int], tuple[int, float, float, float]]:
    """Number, sums of places and inertia of the points nearest to centre k of each run. A task
    answers with a row per run, so only sums are shuffled."""
    names = sorted(runs)
    centres = np.array([runs[r] for r in names], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*centres.shape[:2], 4))
        for _, x, y in _packs(batches):
            total += run_sums(pack(x, y), centres)
        r, k = np.nonzero(total[:, :, 0])
        columns = [pa.array(np.array(names, np.int64)[r]), pa.array(k.astype(np.int32)), *[pa.array(total[r, k, i]) for i in range(4)]]
        yield pa.RecordBatch.from_arrays(columns, names=["run", "k", "n", "sx", "sy", "inertia"])

    sums = _places(points).mapInArrow(run, "run long, k int, n double, sx double, sy double, inertia double").groupBy("run", "k")
    rows = sums.agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "inertia")]).collect()  # a row for each centre
    return {(row.run, row.k): (int(row.n), row.sx, row.sy, row.inertia) for row in rows}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _greatest(points: DataFrame, runs: dict[int, Places], seed: int | None) -> dict[int, list[tuple[float, float]]]:
    """For each run the points that come first: with a seed one, drawn with a chance in proportion
    to its squared distance to the nearest centre (evenly without centres); else of each centre's
    points the farthest (the lower id on ties), farther ones first."""
    names = sorted(runs)
    centres = np.array([runs[r] for r in names], np.float64).reshape(len(names), -1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (max(1, centres.shape[1]) if seed is None else 1, len(names))
        there, top, least, tx, ty = (np.zeros(shape, t) for t in (bool, np.float64, np.int64, np.float64, np.float64))
        for ids, x, y in _packs(batches):
            step = max(1, DISTANCES // max(1, len(names) * max(1, centres.shape[1])))
            for low in range(0, len(ids), step):
                i, px, py = ids[low : low + step], x[low : low + step], y[low : low + step]
                if centres.shape[1]:
                    d2 = (px[:, None, None] - centres[None, :, :, 0]) ** 2 + (py[:, None, None] - centres[None, :, :, 1]) ** 2
                    k, d2 = d2.argmin(axis=2), d2.min(axis=2)
                else:
                    k, d2 = np.zeros((len(i), len(names)), np.int64), np.ones((len(i), len(names)))
                if seed is None:
                    key = d2
                else:
                    h = _mixed(i.astype(np.int64).view(np.uint64)[:, None] + _mixed(np.array(names, np.int64).view(np.uint64) * np.uint64(64) + np.uint64(seed + 1))[None, :])
                    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
                    with np.errstate(divide="ignore"):
                        key = np.where(d2 > 0, np.log(u) / d2, -np.inf)
                    k = np.zeros_like(k)
                for c in np.unique(k):
                    own = np.where(k == c, key, -np.inf if seed is None else key)
                    best = np.lexsort((np.broadcast_to(-i[:, None], own.shape), own), axis=0)[-1]
                    r = np.arange(len(names))
                    new = k[best, r] == c
                    value, number = own[best, r], -i[best]
                    new &= ~there[c] | (value > top[c]) | ((value == top[c]) & (number > least[c]))
                    there[c] |= new
                    for held, v in ((top, value), (least, number), (tx, px[best]), (ty, py[best])):
                        held[c] = np.where(new, v, held[c])
        c, r = np.nonzero(there)
        columns = [np.array(names, np.int64)[r], c.astype(np.int32), top[c, r], least[c, r], tx[c, r], ty[c, r]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["run", "k", "key", "low", "x", "y"])

    found = _places(points).mapInArrow(run, "run long, k int, key double, low long, x double, y double")
    out: dict[int, list] = {}
    for row in found.groupBy("run", "k").agg(F.max(F.struct("key", "low", "x", "y")).alias("b")).collect():  # a row for each centre
        out.setdefault(row.run, []).append(row.b)
    return {r: [(b.x, b.y) for b in sorted(v, reverse=True)] for r, v in out.items()}


def start_centres(points: DataFrame, k: int, seeds: list[int]) -> list[Places]:
    """For each seed k centres far apart: the first drawn evenly, each other one with a chance in
    proportion to the squared distance to the nearest centre so far. A draw is the greatest
    ``ln(u) / d2`` over the points (``id, x, y``), with u from a hash of seed and id, so all seeds
    share one aggregate for each centre, and only places come to the driver."""
    chosen: dict[int, Places] = {s: [] for s in seeds}
    for i in range(k):
        found = _greatest(points, chosen, i)
        if not found:
            raise ValueError("there are no points")
        for s, (place, *_) in found.items():
            chosen[s] = [*chosen[s], place]
    return [chosen[s] for s in seeds]


def k_means(points: DataFrame, starts: list[Places], most: int | None = 50, tolerance: float = 1e-4, reseed: bool = True) -> list[tuple[Places, float]]:
    """Centres and inertia of a run from each start: Lloyd's steps until no centre moves by more
    than the tolerance (``most`` steps, or as many as it takes with ``None``). A centre without points goes to a point farthest from its own centre (the
    lower id on ties), or stays (``reseed=False``). All runs take a step in one aggregate, and
    only centres come to the driver."""
    return [(places, inertia) for places, inertia, _ in _lloyd(points, starts, most, tolerance, reseed)]


def _lloyd(points: DataFrame, starts: list[Places], most: int | None, tolerance: float, reseed: bool) -> list[tuple[Places, float, list[int]]]:
    now, active = {r: [(float(x), float(y)) for x, y in s] for r, s in enumerate(starts)}, set(range(len(starts)))
    for _ in itertools.count() if most is None else range(most):
        rows = _step(points, {r: now[r] for r in active})
        lacking = {r: now[r] for r in active if any((r, k) not in rows for k in range(len(now[r])))} if reseed else {}
        spare = _greatest(points, lacking, None) if lacking else {}
        for r in sorted(active):
            after = []
            for k, place in enumerate(now[r]):
                if (r, k) in rows:
                    n, sx, sy, _ = rows[r, k]
                    after.append((sx / n, sy / n))
                else:
                    after.append(spare[r].pop(0) if spare.get(r) else place)
            moved = max(max(abs(a - c), abs(b - d)) for (a, b), (c, d) in zip(now[r], after, strict=True))
            now[r] = after
            if moved <= tolerance:
                active.discard(r)
        if not active:
            break
    last = _step(points, now)
    sizes = lambda r: [last.get((r, k), (0,))[0] for k in range(len(now[r]))]
    return [(now[r], sum(last[r, k][3] for k in range(len(now[r])) if (r, k) in last), sizes(r)) for r in range(len(starts))]


def lowest(diagnostics: DataFrame) -> DataFrame:
    """The row of the least inertia, the lower seed on ties."""
    return diagnostics.orderBy("inertia", "seed").limit(1)


def seed_search(points: DataFrame, k: int, seeds, restarts: int = 20, least: int = 1) -> DataFrame:
    """``seed, inertia, least_size, most_size, ratio, sizes, usable, best``: for each seed the
    best of its restarts. A seed is usable if no cluster has fewer than ``least`` points; the
    best usable one has the lowest inertia. All runs of all seeds go side by side."""
    points, out, seeds = kept(_places(points)), [], list(seeds)
    spark = points.sparkSession
    runs = _lloyd(points, start_centres(points, k, [s * 1009 + r for s in seeds for r in range(restarts)]), 50, 1e-4, True)
    for i, seed in enumerate(seeds):
        _, inertia, each = min(runs[i * restarts : (i + 1) * restarts], key=lambda t: t[1])
        ratio = max(each) / min(each) if min(each) else float("inf")
        out.append((seed, inertia, min(each), max(each), ratio, dict(enumerate(each)), min(each) >= least))
    usable = [(row[1], row[0]) for row in out if row[-1]]
    best = min(usable)[1] if usable else None
    rows = [(*row, row[0] == best) for row in out]
    return spark.createDataFrame(rows, "seed int, inertia double, least_size long, most_size long, ratio double, sizes map<int, long>, usable boolean, best boolean")


#: Rows that the first prices are found from, and moves looked at for each pair of clusters.
PRICE_ROWS, MOVES = 4096, 64


def _first_prices(rows: DataFrame, sizes: list[int], n: int) -> list[float]:
    """Prices at which a bounded sample of the rows asks for its share of the sizes."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(PRICE_ROWS).select("cost").collect()
    cost = np.array([r.cost for r in some], np.float64).reshape(len(some), len(sizes))
    price, want = np.zeros(len(sizes)), np.array(sizes) * len(some) / max(1, n)
    step = float(np.ptp(cost)) / 4 if len(some) else 0.0
    for _ in range(2000):
        over = np.bincount((cost + price).argmin(axis=1), minlength=len(sizes)) - want
        price += step * over / max(1.0, len(some))
        step *= 0.997
    return (price - price.min()).tolist()


def _asked(price: list[float]) -> Column:
    """The cluster of least cost plus price, the lower number on ties."""
    return F.array_min(F.transform("cost", lambda c, i: F.struct((c + F.get(F.array(*[F.lit(float(p)) for p in price]), i)).alias("w"), i.alias("k"))))["k"]


def _settled(rows: DataFrame, price: list[float], sizes: list[int]) -> DataFrame:
    """``id, cost, k`` with the sizes met: points that lose most by going elsewhere stay, those
    over the size of their cluster go on to the next choice that has room."""
    done, left, room = None, rows, list(sizes)
    while any(room):
        open_ = [i for i in range(len(room)) if room[i] > 0]
        own = F.array(*[F.struct((F.get("cost", F.lit(i)) + F.lit(float(price[i]))).alias("w"), F.lit(i).alias("k")) for i in open_])
        chosen = left.withColumn("o", F.array_sort(own)).withColumn("k", F.col("o")[0]["k"])
        loss = F.coalesce(F.get("o", F.lit(1))["w"] - F.col("o")[0]["w"], F.lit(0.0))
        ranked = kept(running_totals(chosen.withColumn("loss", loss).drop("o"), ["k"], "loss", ["id"], {"rank": F.lit(1)}, descending=True))
        inside = F.col("rank") <= F.get(F.array(*[F.lit(r) for r in room]), F.col("k"))
        taken = {r.k: r.n for r in ranked.where(inside).groupBy("k").agg(F.count("*").alias("n")).collect()}
        more = ranked.where(inside).select("id", "cost", "k")
        done = more if done is None else done.unionByName(more)
        room = [room[i] - taken.get(i, 0) for i in range(len(room))]
        left = ranked.where(~inside).select("id", "cost")
    return rows.withColumn("k", F.lit(0)).limit(0) if done is None else done


def _cycle(weight: np.ndarray, slack: float) -> list[int]:
    """Clusters around a cycle of negative weight, or none."""
    k = len(weight)
    far, before = np.zeros(k), [-1] * k
    node = -1
    for _ in range(k):
        node = -1
        for a in range(k):
            for b in range(k):
                if a != b and far[a] + weight[a, b] < far[b] - slack:
                    far[b], before[b], node = far[a] + weight[a, b], a, b
        if node < 0:
            return []
    for _ in range(k):
        node = before[node]
    out, at = [node], before[node]
    while at != node:
        out.append(at)
        at = before[at]
    return out[::-1]


def _potentials(weight: np.ndarray) -> np.ndarray:
    far = np.zeros(len(weight))
    for _ in range(len(weight)):
        far = np.minimum(far, (far[:, None] + weight).min(axis=0))
    return far


def _moves(assigned: DataFrame, k: int) -> dict[tuple[int, int], list[tuple[float, int]]]:
    """For pairs of clusters points of the first and what they lose by going to the second: the
    least of each of a number of parts of the points, so the least of all is among them."""
    to = F.explode(F.transform("cost", lambda c, i: F.struct(i.alias("b"), (c - F.get("cost", F.col("k"))).alias("d")))).alias("t")
    each = assigned.select("id", "k", to).where("t.b <> k")
    least = each.groupBy("k", "t.b", F.pmod(F.xxhash64("id"), F.lit(MOVES)).alias("part")).agg(F.min(F.struct(F.col("t.d").alias("d"), "id")).alias("m"))
    out: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for r in least.collect():  # MOVES rows for each pair of clusters
        out.setdefault((r.k, r.b), []).append((r.m.d, r.m.id))
    return {pair: sorted(v) for pair, v in out.items()}


def exact_capacities(points: DataFrame, centres: DataFrame, sizes: list[int], steps: int = 30) -> tuple[DataFrame, float, float]:
    """Every point (``id, x, y``; ids are unique) in a cluster, cluster k with ``sizes[k]`` points, at the least
    total squared distance: ``id, k, d2``, the total, and a lower bound of any total that prices
    prove, equal to it but for rounding.

    Each cluster has a price, and a point goes where squared distance plus price is least; prices
    are found on a sample and then on all points, and what is left over is settled by rank. Then
    points change places along cycles of clusters as long as one lowers the total: what a move from
    one cluster to another costs at least is an aggregate, so a round takes one job and the driver
    holds some moves of each pair. Without such a cycle the total is the least there is, and the
    shortest ways between clusters are the prices that prove it.
    """
    k, n = len(sizes), points.count()
    if sum(sizes) != n:
        raise ValueError("sizes must add up to the number of points")
    held = centres.agg(F.array_sort(F.collect_list(F.struct("k", "cx", "cy"))).alias("__c"))  # k rows
    d2 = lambda c: (F.col("x") - c["cx"]) * (F.col("x") - c["cx"]) + (F.col("y") - c["cy"]) * (F.col("y") - c["cy"])
    rows = kept(points.join(F.broadcast(held), F.lit(True)).select("id", F.transform("__c", d2).alias("cost")))
    price = _first_prices(rows, sizes, n)
    spread = rows.agg(F.max(F.array_max("cost"))).first()[0] or 1.0
    step = spread / 8
    for _ in range(steps):
        asked = {r.k: r.n for r in rows.groupBy(_asked(price).alias("k")).agg(F.count("*").alias("n")).collect()}
        over = [asked.get(i, 0) - sizes[i] for i in range(k)]
        if max(over, default=0) <= max(1, n // 10_000):
            break
        price = [p + step * o / n for p, o in zip(price, over, strict=True)]
        step *= 0.9
    assigned = kept(_settled(rows, price, sizes))
    slack = 1e-12 * spread
    while True:
        moves = _moves(assigned, k)
        weight = lambda: np.array([[moves[a, b][0][0] if moves.get((a, b)) else np.inf for b in range(k)] for a in range(k)]).reshape(k, k)
        first, to = weight(), {}
        while cycle := _cycle(weight(), slack):
            for a, b in zip(cycle, cycle[1:] + cycle[:1], strict=True):
                to[moves[a, b][0][1]] = b
            moves = {pair: [m for m in v if m[1] not in to] for pair, v in moves.items()}
        if not to:
            break
        changed = points.sparkSession.createDataFrame(list(to.items()), "__id long, __k int")  # as many as moves at most
        assigned = kept(assigned.join(F.broadcast(changed), F.col("id") == F.col("__id"), "left").select("id", "cost", F.coalesce("__k", "k").alias("k")))
    np.fill_diagonal(first, 0.0)
    prices = -_potentials(first) if k else np.zeros(0)
    least = F.array_min(F.transform("cost", lambda c, i: c + F.get(F.array(*[F.lit(float(p)) for p in prices]), i)))
    found = assigned.agg(F.sum(F.get("cost", F.col("k"))).alias("total"), F.sum(least).alias("bound")).first()
    bound = (found.bound or 0.0) - sum(float(p) * s for p, s in zip(prices, sizes, strict=True))
    return assigned.select("id", "k", F.get("cost", F.col("k")).alias("d2")), found.total or 0.0, bound


def assign_capacities(points: DataFrame, centres: DataFrame, sizes: list[int]) -> DataFrame:
    """``id, k, d2``: every point in a cluster, cluster k with ``sizes[k]`` points, at the least
    total squared distance (see ``exact_capacities``)."""
    return exact_capacities(points, centres, sizes)[0]


def assigned_clusters(fitted: DataFrame, others: DataFrame) -> DataFrame:
    """``id, k, fitted``: points a clustering was fitted on keep their cluster (``id, x, y, k``),
    others (``id, x, y``) go to the nearest middle of one."""
    middles = fitted.groupBy("k").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    near = nearest_centre(others.select("id", "x", "y"), middles).select("id", "k", F.lit(False).alias("fitted"))
    return fitted.select("id", "k", F.lit(True).alias("fitted")).unionByName(near)


def spatial_blocks(points: DataFrame, blocks: int, seed: int = 42, restarts: int = 10) -> DataFrame:
    """``points (id, x, y, ...)`` with ``block``: the cluster of the best of several runs. Runs take
    as many steps as they need, each of which lowers the inertia; the middle of each block is no
    farther from the centre that it was found by than the tolerance."""
    held = kept(_places(points))
    runs = k_means(held, start_centres(held, blocks, [seed * 1009 + r for r in range(restarts)]), None)
    places, _ = min(runs, key=lambda r: r[1])
    while (after := k_means(held, [places], 1)[0][0]) != places:
        if max(max(abs(a - c), abs(b - d)) for (a, b), (c, d) in zip(places, after, strict=True)) <= 1e-4:
            break
        places = after
    centres = points.sparkSession.createDataFrame([(k, x, y) for k, (x, y) in enumerate(places)], "k int, cx double, cy double")
    return nearest_centre(points, centres).withColumnRenamed("k", "block").drop("d2")


def balance_summary(rows: DataFrame, cluster: str, label: str, chosen: str) -> DataFrame:
    """Per cluster: positives, negatives, chosen negatives and the ratio (infinite for none)."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    out = rows.groupBy(cluster).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.count_if((F.col(label) == 0) & F.col(chosen)).alias("n_chosen"))
    return out.withColumn("ratio", F.when(F.col("n_chosen") == 0, float("inf")).otherwise(F.col("n_pos") / F.col("n_chosen")))
