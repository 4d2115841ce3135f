"""Gaps against every real pixel of their grid, one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from terrasieve.operators import gaps as V

NO = -9999.0
SCHEMA = "id long, row int, col int, v double, inside boolean"


def grids():
    """Grids of many shapes and shares of gaps, cells missing, in odd places, one without a pixel."""
    rng = np.random.default_rng(3)
    rows = []
    for i, (h, w, share, there) in enumerate([(23, 17, 0.3, 1.0), (40, 9, 0.97, 1.0), (9, 60, 0.9, 0.8), (1, 30, 0.5, 1.0), (30, 1, 0.5, 1.0), (25, 25, 0.995, 0.9), (4, 4, 1.0, 1.0), (3, 3, 0.0, 1.0)]):
        for r in range(h):
            for c in range(w):
                if rng.random() < there:
                    gap = rng.random() < share
                    bad = [NO, math.nan, math.inf, None][int(rng.integers(4))]
                    rows.append((None if i == 2 else 2**53 + i, r - 7, c + 1000 * (i == 1), bad if gap else round(float(rng.normal()), 3), bool(rng.random() < 0.8)))
    return rows


def real(v):
    return v is not None and math.isfinite(v) and v != NO


def brute(rows, value, within):
    out = []
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        known = np.array([(r[1], r[2], r[3]) for r in own if real(r[3]) and (r[4] or not within)]).reshape(-1, 3)
        for i, r, c, v, here in own:
            if real(v) or (within and not here):
                out.append((i, r, c, v))
            else:
                found = value(known, r, c) if len(known) else None
                out.append((i, r, c, NO if found is None else found))
    return sorted(out, key=str)


def nearest(known, r, c):
    d2 = (known[:, 0] - r) ** 2 + (known[:, 1] - c) ** 2
    return float(known[np.lexsort((known[:, 1], known[:, 0], d2))[0], 2])


def smooth(reach):
    def value(known, r, c):
        total = weight = 0.0
        for upper in (True, False):
            for lefter in (True, False):
                some = known[((known[:, 0] <= r) == upper) & ((known[:, 1] <= c) == lefter)]
                d2 = (some[:, 0] - r) ** 2 + (some[:, 1] - c) ** 2
                if len(some) and d2.min() <= reach * reach:
                    at = np.lexsort((np.abs(some[:, 1] - c), d2))[0]
                    total, weight = total + some[at, 2] / d2[at] ** 0.5, weight + 1 / d2[at] ** 0.5
        return total / weight if weight else None

    return value


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[3] == b[3] or (a[3] is None and b[3] is None) or a[3] == pytest.approx(b[3], abs=1e-9, nan_ok=True), (a, b)


@pytest.mark.parametrize("cells", [1 << 20, 40])
@pytest.mark.parametrize("within", [False, True])
def test_nearest(spark, monkeypatch, cells, within):
    monkeypatch.setattr(V, "BLOCK_CELLS", cells)
    rows = grids()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = V.filled_nearest(df, ["id"], within=F.col("inside") if within else None)
    same(sorted(map(tuple, got.collect()), key=str), brute(rows, nearest, within))


@pytest.mark.parametrize("cells", [1 << 20, 40])
@pytest.mark.parametrize("reach", [1, 6, 1000])
def test_smooth(spark, monkeypatch, cells, reach):
    monkeypatch.setattr(V, "BLOCK_CELLS", cells)
    rows = grids()
    got = V.filled_smooth(spark.createDataFrame(rows, SCHEMA), ["id"], reach)
    same(sorted(map(tuple, got.collect()), key=str), brute(rows, smooth(reach), False))


def test_row_minima():
    rng = np.random.default_rng(1)
    for _ in range(300):
        spots = sorted({(int(rng.integers(4)), int(rng.integers(30))) for _ in range(int(rng.integers(0, 40)))})
        asked = sorted({(int(rng.integers(4)), int(rng.integers(30))) for _ in range(int(rng.integers(1, 40)))})
        row, x = (np.array([s[k] for s in spots], np.int64) for k in (0, 1))
        w = rng.integers(0, 60, len(spots))
        for before in (None, "or at", "strictly"):
            got = V.row_minima(row, x, w, np.array([a[0] for a in asked]), np.array([a[1] for a in asked]), 2, before)
            for (r, c), g in zip(asked, got, strict=True):
                ok = [i for i, s in enumerate(spots) if s[0] == r and (before is None or s[1] < c or (s[1] == c and before == "or at"))]
                cost = {i: 2 * (spots[i][1] - c) ** 2 + int(w[i]) for i in ok}
                best = [i for i in ok if cost[i] == min(cost.values())]
                assert g == (-1 if not ok else best[0] if before is None else best[-1])


def test_empty(spark):
    assert V.filled_nearest(spark.createDataFrame([], SCHEMA), ["id"]).count() == 0
