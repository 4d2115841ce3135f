"""Whitening of embeddings: covariance by generated column aggregates, components by LAPACK.

Entries become integers, so that sums are exact. The covariance comes from one aggregation with a
generated SQL expression for every pair of the upper triangle: each sums the product of two
dimensions, centred on the integers next to their means; the remainders of the means are taken off
after. Sums of such products are whole numbers, exact and the same in every run up to 2^53. The
matrix of a row per dimension goes to the driver, whose size depends on the number of dimensions
only, and is decomposed there. The same expressions, over the whitened columns, measure how far
their covariance is from the identity.

The fit list holds each distinct vector once, so neither copies nor repeated rows weigh more. Rows
whose vector is null, empty, or holds a null or a number that is not finite are dropped, as are
those of another length than most vectors have (of lengths that tie, the greater). Entries beyond
2^56 in size are cut there, as their integers would leave a long. Null ``vec_id`` is kept, repeated
rows each give rows, other columns are ignored. Components without variance (rounding aside) can't
be whitened and give no rows: an empty table, or one with a single distinct vector, has no result.
``deviation`` is null where it leaves a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Sums that one aggregation should have at most; wider vectors take several.
MOST_SUMS = 8192
#: Eigenvalues below this share of the greatest are rounding.
RANK = 1e-13
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, x``: the rows that count, their entries as integers."""
    most = float(1 << 56)
    held = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    held = held.where("v is not null and size(v) > 0").where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    lengths = held.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    whole = lambda c: F.floor(F.lit(float(SCALE)) * F.greatest(F.least(c, F.lit(most)), F.lit(-most))) + F.lit(OFFSET)
    return held.where(F.size("v") == (lengths.d if lengths else 0)).select("vec_id", F.transform("v", whole).alias("x"))


def pair_sums(rows: DataFrame, column: str, d: int) -> np.ndarray:
    """The matrix of sums of products of the entries of an array column (``d`` long)."""
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for k in range(0, len(pairs), MOST_SUMS):
        some = pairs[k : k + MOST_SUMS]
        row = rows.selectExpr(*[f"sum({column}[{i}] * {column}[{j}]) AS s_{i}_{j}" for i, j in some]).first()
        for (i, j), s in zip(some, row, strict=True):
            out[i, j] = out[j, i] = s or 0.0
    return out


@dataclass
class Whitener:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> list[int]:
        """The integers next to the means."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Integers less their means; the part of the mean after the point goes last."""
        rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, self.centre, strict=True)])
        return (x - np.array(self.centre, np.int64)).astype(np.float64) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - S)^2 for each row."""
        most = max((abs(self.n * int(v) - s) for edge in (x.min(axis=0), x.max(axis=0)) for v, s in zip(edge, self.sums, strict=True)), default=0)
        kind = np.int64 if most * most * len(self.sums) < 2**63 and self.n * int(np.abs(x).max()) < 2**63 else object
        gap = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [int(v) if v < 2**63 else None for v in (gap * gap).sum(axis=1)]


def fit(distinct: DataFrame, most: int = COMPONENTS) -> Whitener | None:
    """Learns from distinct vectors (column ``x``); None without any variance."""
    first = distinct.first()
    if first is None:
        return None
    d = len(first.x)
    exact = distinct.selectExpr("count(*) AS n", *[f"sum(cast(x[{i}] AS decimal(38, 0))) AS s{i}" for i in range(d)]).first()
    w = Whitener(exact.n, [int(s) for s in exact[1:]], np.zeros(0), np.zeros((d, 0)), 0.0)
    middle = F.array(*[F.lit(m) for m in w.centre])
    centred = distinct.select(F.zip_with("x", middle, lambda a, m: (a - m).cast("double")).alias("c"))
    rest = np.array([(s - w.n * m) / w.n for s, m in zip(w.sums, w.centre, strict=True)])
    covariance = pair_sums(centred, "c", d) / w.n - np.outer(rest, rest)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(most, int((values > RANK * max(values[0], 0.0)).sum()) if values[0] > 0 else 0)
    if not keep:
        return None
    return Whitener(w.n, w.sums, values[:keep], vectors[:, :keep], float(np.trace(covariance)))


def identity_error(distinct: DataFrame, w: Whitener) -> float:
    """The largest entry, sign aside, of the whitened fit list's covariance less the identity."""
    d = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = w.whiten(_matrix(b.column(0), len(w.sums)))
            yield pa.RecordBatch.from_arrays([pa.array(list(z), pa.list_(pa.float64()))], names=["z"])

    z = distinct.select("x").mapInArrow(run, "z array<double>")
    mean = z.selectExpr(*[f"avg(z[{i}]) AS m{i}" for i in range(d)]).first()
    centred = z.select(F.zip_with("z", F.array(*[F.lit(float(m)) for m in mean]), lambda a, m: a - m).alias("c"))
    return float(np.abs(pair_sums(centred, "c", d) / w.n - np.eye(d)).max())


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: ``n`` of the fit list, the vector's ``deviation``, its
    ``whitened`` value, the share of the variance that the component has, and the measured error
    of the whitened covariance."""
    held = scaled(rows, vector, key)
    distinct = materialise(held.select("x").distinct(), "whitening")
    w = fit(distinct, most)
    if w is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    error, k = identity_error(distinct, w), len(w.values)
    share = w.values / w.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), len(w.sums))
            at = np.repeat(np.arange(len(x)), k)
            columns = [
                b.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), w.n, np.int64)),
                pa.array(w.deviation(x), pa.int64()).take(pa.array(at)),
                pa.array(w.whiten(x).ravel()),
                pa.array(np.tile(share, len(x))),
                pa.array(np.full(len(at), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.mapInArrow(run, SCHEMA)
