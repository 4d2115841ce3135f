"""Points and polygons against every edge, one by one."""

import json
import math
import random

import pytest
from terrasieve.operators import polygons as P
from terrasieve.sources import polygons as R

RINGS = "polygon string, corners array<struct<x: double, y: double>>"


def star(r, x, y, n, size):
    turns = sorted(r.random() * 2 * math.pi for _ in range(n))
    return [(x + size * (0.3 + r.random()) * math.cos(t), y + size * (0.3 + r.random()) * math.sin(t)) for t in turns]


def shapes():
    r = random.Random(5)
    out = [(f"s{i}", star(r, r.uniform(-3, 3), r.uniform(-3, 3), r.randrange(3, 14), r.choice([0.02, 0.5, 2.5]))) for i in range(30)]
    box = lambda a, b, c, d: [(float(x), float(y)) for x, y in ((a, b), (c, b), (c, d), (a, d))]
    out += [("holed", box(-2, -2, 2, 2)), ("holed", box(-1, -1, 1, 1)), ("parts", box(-3, -3, -2.5, -2.5)), ("parts", box(2.5, 2.5, 3, 3)), ("closed", [*box(0, 0, 1, 1), (0.0, 0.0)]), ("bow", [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)])]
    return out + [("line", [(0.0, 0.0), (1.0, 1.0)]), ("spot", [(0.0, 0.0)]), (None, box(0, 0, 1, 1)), ("none", [])]


def places():
    r = random.Random(6)
    grid = [(x / 2, y / 2) for x in range(-7, 8) for y in range(-7, 8)]  # corners and edges among them
    free = [(r.uniform(-4, 4), r.uniform(-4, 4)) for _ in range(400)]
    return [(i, x, y) for i, (x, y) in enumerate(grid + free)] + [(2**53 + 1, 0.1, 0.2), (9999, None, 1.0)]


def all_edges(rings):
    out = {}
    for name, c in rings:
        if name is not None:
            out.setdefault(name, []).extend((a, b) for a, b in zip(c, c[1:] + c[:1], strict=True) if a != b)
    return out


def holds(es, x, y):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in es) % 2 == 1


def distance(es, x, y):
    best = math.inf
    for (x1, y1), (x2, y2) in es:
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return best


def frames(spark):
    return spark.createDataFrame(places(), "id long, x double, y double").repartition(3), spark.createDataFrame(shapes(), RINGS)


@pytest.mark.parametrize("width", [0.13, 1.0, 50.0])
def test_points_in(spark, width):
    points, rings = frames(spark)
    want = sorted((i, name) for i, x, y in places() if x is not None for name, es in all_edges(shapes()).items() if holds(es, x, y))
    assert sorted(map(tuple, P.points_in(points, rings, width).collect())) == want
    ids = {i for i, _ in want}
    assert sorted(r.id for r in P.inside_any(points, rings, width).collect()) == sorted(ids)
    assert sorted(r.id for r in P.outside(points, rings, width).collect()) == sorted({i for i, _, _ in places()} - ids)


@pytest.mark.parametrize("radius", [0.2, 1.5])
def test_points_near(spark, radius):
    points, rings = frames(spark)
    got = {(r.id, r.polygon): r.d for r in P.points_near(points, rings, radius).collect()}
    want = {}
    for i, x, y in places():
        for name, es in all_edges(shapes()).items():
            if x is not None and es:
                d = 0.0 if holds(es, x, y) else distance(es, x, y)
                if d <= radius:
                    want[i, name] = d
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_cover_tells_inside_from_edge(spark):
    _, rings = frames(spark)
    covers = P.cover(rings, 0.25).collect()
    es = all_edges(shapes())
    assert len(covers) == len({(c.polygon, c.gx, c.gy) for c in covers})
    inner = {(c.polygon, c.gx, c.gy): c.inner for c in covers}
    for name, own in es.items():
        for gx in range(-16, 16):
            for gy in range(-16, 16):
                x, y = (gx + 0.5) * 0.25, (gy + 0.5) * 0.25
                if distance(own, x, y) > 0.25:  # no edge in the cell
                    assert inner.get((name, gx, gy), None) == (True if holds(own, x, y) else None)
    union = {(c.gx, c.gy): c.inner for c in P.union_cells(P.cover(rings, 0.25)).collect()}
    assert union == {(gx, gy): any(v for (_, a, b), v in inner.items() if (a, b) == (gx, gy)) for gx, gy in {(a, b) for _, a, b in inner}}


def test_reading(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2]]]
    far = [[[10, 10, 5], [12, 10, 5], [12, 12, 5]]]
    items = [("Polygon", square), ("MultiPolygon", [square, far]), ("Point", [1, 2]), ("Polygon", []), ("Polygon", [[[0, 0], [1, 1]]]), (None, None)]
    collection = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": t, "coordinates": c} if t else None, "properties": {"k": str(i)}} for i, (t, c) in enumerate(items)]}
    (tmp_path / "landslide_polygons.geojson").write_text(json.dumps(collection))
    rings = R.read_polygons(spark, str(tmp_path / "landslide_polygons.geojson"))
    assert sorted((r.polygon[-5:], r.part, r.ring, len(r.corners), r.properties["k"]) for r in rings.collect()) == [("00000", 0, 0, 5, "0"), ("00000", 0, 1, 4, "0"), ("00001", 0, 0, 5, "1"), ("00001", 0, 1, 4, "1"), ("00001", 1, 0, 3, "1")]
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 11.5, 11.0)], "id long, x double, y double")
    assert sorted((r.id, r.polygon[-5:]) for r in P.points_in(points, rings, 1.0).collect()) == [(1, "00000"), (1, "00001"), (3, "00001")]
    assert R.polygon_file(["a.csv", "landslide_polygons.GeoJSON", "landslide_polygons.geojson"]) == "landslide_polygons.GeoJSON"
    assert R.polygon_file(["landslide_points.csv"]) is None
    none = R.optional_polygons(spark, None)
    assert none.count() == 0 and P.points_in(points, none, 1.0).count() == 0 and P.outside(points, none, 1.0).count() == 3
