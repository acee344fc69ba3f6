import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lotline.functions import geo
from lotline.functions.geo import Box, polygons_of
from lotline.operators import containment as containment_module
from lotline.operators import nearest as nearest_module
from lotline.operators.clusters import cluster_rollup
from lotline.operators.containment import hit_test, lines_within, points_within, within_any
from lotline.operators.nearest import nearest, nearest_line, nearest_polygon
from lotline.operators.tiles import point_tile_rollup, tile_rollup

POINTS = "point_id bigint, lon double, lat double"
POLYGONS = "polygon_id bigint, ord bigint, rings array<array<array<array<double>>>>"


def closed(points):
    return [*points, points[0]]


def box(x0, y0, x1, y1):
    return closed([[x0, y0], [x1, y0], [x1, y1], [x0, y1]])


# --- containment ----------------------------------------------------------------------------


def winding_inside(x, y, rings):
    """Even-odd by total angle: another method than the library's."""
    odd = False
    for ring in rings:
        total = 0.0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            turn = math.atan2(y2 - y, x2 - x) - math.atan2(y1 - y, x1 - x)
            total += (turn + math.pi) % (2 * math.pi) - math.pi
        odd ^= round(total / (2 * math.pi)) % 2 != 0
    return odd


def star(rng, cx, cy, r, n):
    """A simple polygon around a centre, not convex in general."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return closed([[cx + r * rng.uniform(0.3, 1) * math.cos(a), cy + r * rng.uniform(0.3, 1) * math.sin(a)] for a in angles])


def test_edges_corners_and_holes(spark):
    square = [[box(0.0, 0.0, 4.0, 4.0), box(1.0, 1.0, 2.0, 2.0)]]
    two = [[box(10.0, 0.0, 11.0, 1.0)], [box(10.5, 0.0, 12.0, 1.0)]]
    diagonal = [[closed([[20.0, 0.0], [22.0, 2.0], [20.0, 4.0], [18.0, 2.0]])]]
    polygons = spark.createDataFrame([(1, 1, square), (2, 2, two), (3, 3, diagonal), (4, 4, None)], POLYGONS)
    expected = {
        (0.5, 0.5): [1],
        (0.0, 2.0): [],
        (4.0, 4.0): [],
        (2.0, 4.0): [],
        (1.5, 1.5): [],
        (1.0, 1.5): [],
        (2.5, 1.0): [1],
        (10.2, 0.5): [2],
        (10.75, 0.5): [2],
        (11.5, 0.5): [2],
        (10.5, 0.5): [2],
        (20.0, 2.0): [3],
        (19.0, 1.0): [],
        (18.0, 2.0): [],
        (18.5, 2.0): [3],
    }
    rows = [(i, x, y) for i, (x, y) in enumerate(expected)] + [(99, None, 1.0)]
    points = spark.createDataFrame(rows, POINTS)
    got = {}
    for r in points_within(points, polygons).collect():
        got.setdefault(r.point_id, []).append(r.polygon_id)
    assert got == {i: v for i, v in enumerate(expected.values()) if v}
    flags = {r.point_id: r.within for r in within_any(points, polygons).collect()}
    assert flags == {**{i: bool(v) for i, v in enumerate(expected.values())}, 99: False}


@pytest.mark.parametrize("broadcast_bytes", [0, containment_module.BROADCAST_BYTES])
def test_containment_against_brute_force(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(containment_module, "BROADCAST_BYTES", broadcast_bytes)
    rng = random.Random(3)
    polygons = []
    for i in range(40):
        cx, cy, r = rng.uniform(-175, 175), rng.uniform(-80, 80), 10 ** rng.uniform(-2, 1.2)
        if i % 3 == 0:
            cx, cy = rng.uniform(0, 1), rng.uniform(0, 1)
        rings = [star(rng, cx, cy, r, rng.randint(3, 12))]
        if i % 2:
            rings.append(star(rng, cx, cy, r * 0.2, 5))
        polygons.append((i, 1000 - i, [rings, [star(rng, cx + 3 * r, cy, r, 6)]] if i % 5 == 0 else [rings]))
    polygons.append((100, 5, polygons[0][2]))
    points = []
    for i in range(600):
        near = rng.choice(polygons)[2][0][0][0]
        spread = 10 ** rng.uniform(-2, 1)
        points.append((i, near[0] + rng.gauss(0, spread), near[1] + rng.gauss(0, spread)))
    want = {(p, g) for p, x, y in points for g, _, parts in polygons if any(winding_inside(x, y, rings) for rings in parts)}
    assert len(want) > 100
    p, g = spark.createDataFrame(points, POINTS), spark.createDataFrame(polygons, POLYGONS)
    rows = [(r.point_id, r.polygon_id) for r in points_within(p, g).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    rank = {g: ord for g, ord, _ in polygons}
    firsts = {}
    for point, polygon in want:
        firsts[point] = min(firsts.get(point, polygon), polygon, key=rank.get)
    assert {r.point_id: r.polygon_id for r in hit_test(p, g).collect()} == firsts


def test_equal_point_rows_give_equal_pairs(spark):
    polygons = spark.createDataFrame([(1, 1, [[box(0.0, 0.0, 1.0, 1.0)]]), (2, 2, [[box(0.0, 0.0, 2.0, 2.0)]])], POLYGONS)
    points = spark.createDataFrame([(7, 0.5, 0.5)] * 3 + [(8, 1.5, 1.5), (7, 1.5, 1.5)], POINTS)
    assert sorted((r.point_id, r.polygon_id) for r in points_within(points, polygons).collect()) == (
        [(7, 1)] * 3 + [(7, 2)] * 4 + [(8, 2)]
    )


def test_polygons_out_of_features(spark):
    square = {"type": "Polygon", "coordinates": [box(0, 0, 2, 2), box(0.5, 0.5, 1, 1)]}
    several = {"type": "MultiPolygon", "coordinates": [[box(5, 5, 6, 6)], [box(7, 7, 8, 8)]]}
    other = {"type": "Point", "coordinates": [5.5, 5.5]}
    features = [(i, g and json.dumps(g)) for i, g in enumerate((square, several, other, None))]
    polygons = spark.createDataFrame(features, "ord bigint, geometry string").select(
        F.col("ord").alias("polygon_id"), "ord", polygons_of(F.col("geometry")).alias("rings")
    )
    points = spark.createDataFrame([(0, 1.5, 1.5), (1, 0.7, 0.7), (2, 5.5, 5.5), (3, 7.5, 7.5)], POINTS)
    assert {(r.point_id, r.polygon_id) for r in points_within(points, polygons).collect()} == {(0, 0), (2, 1), (3, 1)}


def test_no_polygons(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], POINTS)
    none = spark.createDataFrame([], POLYGONS)
    assert points_within(points, none).count() == 0
    assert [r.within for r in within_any(points, none).collect()] == [False]


LINES = "line_id bigint, paths array<array<array<double>>>"


def crossing(a, b, c, d):
    """Whether two edges meet within both, by solving for the place; another method than the library's."""
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    det = rx * sy - ry * sx
    if det == 0:
        return False
    t = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / det
    u = ((c[0] - a[0]) * ry - (c[1] - a[1]) * rx) / det
    return 0 < t < 1 and 0 < u < 1


def brute_lines_within(lines, polygons):
    out = []
    for line, paths in lines:
        used = [p for p in paths or [] if p]
        for polygon, _, parts in polygons:
            fits = lambda path, rings: all(winding_inside(x, y, rings) for x, y in path) and not any(
                crossing(a, b, c, d) for a, b in zip(path, path[1:]) for ring in rings for c, d in zip(ring, ring[1:])
            )
            if used and all(any(fits(path, rings) for rings in parts or []) for path in used):
                out.append((line, polygon))
    return sorted(out)


def test_lines_touching_crossing_and_in_holes(spark):
    notched = [[closed([[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 1.0], [0.0, 4.0]]), box(0.5, 0.2, 1.0, 0.4)], [box(10.0, 0.0, 12.0, 2.0)]]
    polygons = [(1, 1, notched), (2, 2, [[box(-1.0, -1.0, 13.0, 5.0)]]), (3, 3, None), (2, 4, [[box(-1.0, -1.0, 13.0, 5.0)]])]
    paths = {
        1: [[[0.5, 2.0], [0.6, 0.6], [3.4, 0.6]]],  # below the notch
        2: [[[0.5, 2.5], [3.5, 2.5]]],  # across it, with both ends inside
        3: [[[1.0, 1.0], [3.0, 1.0]]],  # touches the notch's corner
        4: [[[0.2, 0.3], [1.5, 0.3]]],  # across the hole
        5: [[[0.0, 1.0], [1.0, 1.0]]],  # begins on an edge
        6: [[[0.7, 0.3], [0.8, 0.3]]],  # in the hole
        7: [[[10.5, 0.5], [11.5, 1.5]], [[0.5, 1.0], [1.0, 1.0]]],  # in two parts
        8: [[[3.5, 0.5], [10.5, 0.5]]],  # from one part to another
        9: [[[1.5, 0.5]], []],  # one point
        10: [[]],
        11: None,
        12: [[[1.0, 1.0], [None, 1.0]]],
    }
    lines = list(paths.items())
    got = lines_within(spark.createDataFrame([*lines, lines[0]], LINES), spark.createDataFrame(polygons, POLYGONS)).collect()
    inside = {1: [1, 2], 2: [2], 3: [1, 2], 4: [2], 5: [2], 6: [2], 7: [1, 2], 8: [2], 9: [1, 2]}
    want = [(i, g) for i, found in inside.items() for g in found for _ in range((2 if g == 2 else 1) * (2 if i == 1 else 1))]
    assert sorted((r.line_id, r.polygon_id) for r in got) == sorted(want)


@pytest.mark.parametrize("broadcast_bytes", [0, containment_module.BROADCAST_BYTES])
def test_lines_within_against_brute_force(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(containment_module, "BROADCAST_BYTES", broadcast_bytes)
    rng = random.Random(12)
    polygons = [p for p in outlines(rng, 30) if p[2]]
    lines = []
    for i in range(300):
        ring = rng.choice(polygons)[2][0][0]
        cx, cy = sum(p[0] for p in ring[:-1]) / (len(ring) - 1), sum(p[1] for p in ring[:-1]) / (len(ring) - 1)
        r = max(abs(p[0] - cx) for p in ring) * 10 ** rng.uniform(-1.5, 0)
        lines.append((i, [[[cx + rng.gauss(0, r), cy + rng.gauss(0, r)] for _ in range(rng.randint(1, 4))] for _ in range(rng.choice([1, 1, 2]))]))
    want = brute_lines_within(lines, polygons)
    vertices = {(i, g) for i, paths in lines for g, _, parts in polygons if all(any(winding_inside(x, y, rings) for rings in parts) for p in paths for x, y in p)}
    assert len(want) > 40 and vertices - set(want)
    got = lines_within(spark.createDataFrame(lines, LINES), spark.createDataFrame(polygons, POLYGONS))
    assert sorted((r.line_id, r.polygon_id) for r in got.collect()) == want


def test_covers_carry_few_edges(spark):
    """A polygon of many edges: inner cells have none, the others a small part of them, and no result changes."""
    n = 3000
    ring = closed([[10 + (1 + 0.05 * math.sin(40 * a)) * math.cos(a), 50 + (1 + 0.05 * math.sin(40 * a)) * math.sin(a)] for a in (2 * math.pi * k / n for k in range(n))])
    polygons = spark.createDataFrame([(1, 1, [[ring]])], POLYGONS)
    cells = containment_module.cover(polygons, "polygon_id", "rings", "ord").cells
    most, inner, edges = cells.agg(F.max(F.size(F.flatten("parts"))), F.count_if("inner"), F.count_if(~F.col("inner"))).first()
    assert most < n / 5 and inner > edges / 4 and cells.where("inner and parts is not null").isEmpty()
    rng = random.Random(1)
    points = [(i, 10 + rng.uniform(-1.2, 1.2), 50 + rng.uniform(-1.2, 1.2)) for i in range(400)]
    got = {r.point_id for r in points_within(spark.createDataFrame(points, POINTS), polygons).collect()}
    assert got == {i for i, x, y in points if winding_inside(x, y, [ring])}


# --- nearest --------------------------------------------------------------------------------


def metres(px, py, tx, ty):
    f = 1 / 298.257223563
    e2, c = f * (2 - f), math.cos(math.radians(py))
    w2 = 1 / (1 - e2 * (1 - c * c))
    step = math.radians(1) * 6378137.0
    dlon = (px - tx + 540) % 360 - 180
    return math.hypot(dlon * step * math.sqrt(w2) * c, (py - ty) * step * math.sqrt(w2) * w2 * (1 - e2))


def places(rng, n):
    """Clusters of very different density, copies, and both sides of the date line."""
    rows = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35:
            rows.append((rng.gauss(10, 1e-4), rng.gauss(50, 1e-4)))
        elif kind < 0.5:
            rows.append((10.0, 50.0))
        elif kind < 0.7:
            rows.append(((180 + rng.gauss(0, 2) + 180) % 360 - 180, rng.uniform(-10, 10)))
        else:
            rows.append((rng.uniform(-180, 180), rng.uniform(-85, 85)))
    return rows


@pytest.mark.parametrize("capacity", [2, 32])
def test_nearest_against_brute_force(spark, monkeypatch, capacity):
    monkeypatch.setattr(nearest_module, "CELL_CAPACITY", capacity)
    if capacity == 2:
        monkeypatch.setattr(nearest_module, "BROADCAST_ROWS", 0)
    rng = random.Random(capacity)
    points = [(i, *p) for i, p in enumerate(places(rng, 250))] + [(900, None, 1.0)]
    targets = [(i, *p) for i, p in enumerate(places(rng, 300))]
    found = nearest(
        spark.createDataFrame(points, POINTS), spark.createDataFrame(targets, "target_id bigint, lon double, lat double")
    ).collect()
    assert len(found) == len(points)
    got = {r.point_id: r for r in found}
    assert got[900].target_id is None and got[900].metres is None
    by_id = {t[0]: t[1:] for t in targets}
    for point, x, y in points[:-1]:
        distances = {t: metres(x, y, *xy) for t, xy in by_id.items()}
        best = min(distances.values())
        assert math.isclose(got[point].metres, best, rel_tol=1e-9, abs_tol=1e-6)
        assert math.isclose(distances[got[point].target_id], best, rel_tol=1e-9, abs_tol=1e-6)
        # Of copies the lowest id.
        assert got[point].target_id == min(t for t in by_id if by_id[t] == by_id[got[point].target_id])


def test_nearest_of_one_or_none(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, -0.0, -0.0)], POINTS)
    one = spark.createDataFrame([(5, 1.0, 0.0)], "target_id bigint, lon double, lat double")
    rows = nearest(points, one).collect()
    assert [r.target_id for r in rows] == [5, 5] and math.isclose(rows[0].metres, 111319.49, rel_tol=1e-6)
    assert [r.target_id for r in nearest(points, one.limit(0)).collect()] == [None, None]


def to_segment(px, py, a, b):
    """By trying places along the segment ever closer to the best one; another method than the library's."""
    x2 = a[0] + (b[0] - a[0] + 540) % 360 - 180
    low, high = 0.0, 1.0
    for _ in range(100):
        m, n = low + (high - low) / 3, high - (high - low) / 3
        if unwrapped(px, py, a[0] + (x2 - a[0]) * m, a[1] + (b[1] - a[1]) * m, a[0]) <= unwrapped(px, py, a[0] + (x2 - a[0]) * n, a[1] + (b[1] - a[1]) * n, a[0]):
            high = n
        else:
            low = m
    t = (low + high) / 2
    return min(metres(px, py, a[0] + (x2 - a[0]) * s, a[1] + (b[1] - a[1]) * s) for s in (0.0, t, 1.0))


def unwrapped(px, py, tx, ty, start):
    """Metres, with the point on the side of the earth that is nearer to the segment's start."""
    f = 1 / 298.257223563
    e2, c = f * (2 - f), math.cos(math.radians(py))
    w2 = 1 / (1 - e2 * (1 - c * c))
    step = math.radians(1) * 6378137.0
    dlon = (px - start + 540) % 360 - 180 - (tx - start)
    return math.hypot(dlon * step * math.sqrt(w2) * c, (py - ty) * step * math.sqrt(w2) * w2 * (1 - e2))


def outlines(rng, n):
    """Polygons of very different sizes with holes and parts; some are copies."""
    out = []
    for i in range(n):
        cx, cy, r = rng.choice([(rng.uniform(-160, 160), rng.uniform(-70, 70), 10 ** rng.uniform(-3, 1)), (10 + rng.gauss(0, 0.01), 50 + rng.gauss(0, 0.01), 10 ** rng.uniform(-4, -2))])
        part = [star(rng, cx, cy, r, rng.randint(3, 9)), star(rng, cx, cy, r * 0.2, 4)]
        out.append((i, 0, [part, [star(rng, cx + 4 * r, cy, r, 5)]] if i % 4 == 0 else [part]))
    return [*out, (n, 0, out[1][2]), (n + 1, 0, None), (n + 2, 0, [])]


@pytest.mark.parametrize("capacity", [2, 32])
def test_nearest_polygon_against_brute_force(spark, monkeypatch, capacity):
    monkeypatch.setattr(nearest_module, "CELL_CAPACITY", capacity)
    if capacity == 2:
        monkeypatch.setattr(nearest_module, "BROADCAST_ROWS", 0)
    rng = random.Random(capacity)
    polygons = outlines(rng, 40)
    points = [(i, *p) for i, p in enumerate(places(rng, 120))]
    for _, _, parts in polygons[:20]:  # corners, and places near the middle
        x, y = parts[0][0][0]
        points += [(len(points), x, y), (len(points) + 1, sum(p[0] for p in parts[0][0][:-1]) / (len(parts[0][0]) - 1), y + 1e-6)]
    points.append((900, None, 1.0))
    found = nearest_polygon(spark.createDataFrame(points, POINTS), spark.createDataFrame(polygons, POLYGONS)).collect()
    assert len(found) == len(points)
    got = {r.point_id: r for r in found}
    assert got[900].target_id is None and got[900].metres is None
    zeros = 0
    for point, x, y in points[:-1]:
        distances = {}
        for g, _, parts in polygons[:-2]:
            if any(winding_inside(x, y, rings) for rings in parts):
                distances[g] = 0.0
            else:
                distances[g] = min(to_segment(x, y, a, b) for rings in parts for ring in rings for a, b in zip(ring, ring[1:]))
        best = min(distances.values())
        zeros += best == 0
        assert math.isclose(got[point].metres, best, rel_tol=1e-7, abs_tol=1e-5)
        assert math.isclose(distances[got[point].target_id], best, rel_tol=1e-7, abs_tol=1e-5)
        # Of copies, and of polygons around a point, the lowest id.
        assert best > 1e-5 or got[point].target_id <= min(g for g, d in distances.items() if d == best)
    assert zeros > 5


def test_nearest_line_over_the_date_line_and_long_ones(spark):
    lines = [
        (3, [[[179.0, 10.0], [-179.0, 12.0]]]),
        (4, [[[-50.0, -20.0], [60.0, -21.0], [60.0, -40.0]], [[0.0, 40.0], [0.0, 41.0]]]),
        (2, [[[0.0, 40.0], [0.0, 41.0]]]),
        (9, [[[5.0, 5.0]]]),
        (8, [[[7.0, 7.0], [7.0, 7.0]]]),
        (7, None),
    ]
    rng = random.Random(4)
    points = [(i, rng.uniform(-180, 180), rng.uniform(-60, 60)) for i in range(150)] + [(500, -180.0, 11.0), (501, 180.0, 11.0), (502, 0.0, 40.5), (503, 7.1, 7.1)]
    found = nearest_line(spark.createDataFrame(points, POINTS), spark.createDataFrame(lines, "line_id bigint, paths array<array<array<double>>>"))
    got = {r.point_id: r for r in found.collect()}
    assert (got[500].target_id, got[501].target_id, got[502].target_id, got[503].target_id) == (3, 3, 2, 8)
    assert got[500].metres == pytest.approx(0, abs=1e-6) and got[502].metres == 0
    for i, x, y in points:
        best = min(to_segment(x, y, a, b) for _, paths in lines for path in paths or [] for a, b in zip(path, path[1:]))
        assert math.isclose(got[i].metres, best, rel_tol=1e-7, abs_tol=1e-5)


def test_nearest_of_no_polygons_or_lines(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], POINTS)
    assert [tuple(r) for r in nearest_polygon(points, spark.createDataFrame([(1, 1, None)], POLYGONS)).collect()] == [(1, None, None)]
    none = spark.createDataFrame([], "line_id string, paths array<array<array<double>>>")
    assert [tuple(r) for r in nearest_line(points, none).collect()] == [(1, None, None)]


def test_a_dense_spot_and_a_far_one_make_two_tables_and_no_window(spark, monkeypatch):
    """Cells are split where they are full, below one grid for all, in one pass over the items."""
    rng = random.Random(9)
    spot = [(i, 10 + rng.gauss(0, 1e-6), 50 + rng.gauss(0, 1e-6)) for i in range(400)]
    targets = [*spot, *((1000 + i, rng.uniform(-170, 170), rng.uniform(-80, 80)) for i in range(30)), (5000, -179.0, -89.0)]
    points = [(i, 10 + rng.gauss(0, 2e-6), 50 + rng.gauss(0, 2e-6)) for i in range(100)] + [(200 + i, rng.uniform(-180, 180), rng.uniform(-85, 85)) for i in range(50)]
    kept, keep = [], nearest_module.keep
    monkeypatch.setattr(nearest_module, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    found = nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(targets, "target_id bigint, lon double, lat double"))
    got = {r.point_id: r for r in found.collect()}
    for i, x, y in points:
        assert math.isclose(got[i].metres, min(metres(x, y, *t[1:]) for t in targets), rel_tol=1e-9, abs_tol=1e-6)
    assert len(kept) == 2 and "Window" not in found._jdf.queryExecution().toString()
    cells = kept[1]
    even = cells.agg(F.min("level"), F.max("level")).first()
    assert even[0] == 2 and even[1] > 16
    # Below the grid for all there are cells around the dense spot only, not around the far one.
    assert cells.where("level = 2 AND x0 < -170").count() and cells.where("level > 2 AND x0 < -170").isEmpty()


# --- tiles ----------------------------------------------------------------------------------


def test_point_tiles(spark):
    rows = [(0.0, 0.0, "a"), (-180.0, 85.06, "a"), (180.0, -89.0, "a"), (179.9, -90.0, "b"), (None, 1.0, "a")]
    df = spark.createDataFrame(rows, "lon double, lat double, c string")
    got = {(r.x, r.y, r.c): r.n_features for r in point_tile_rollup(df, "lon", "lat", 2, "c").collect()}
    # Longitude 180 is longitude -180.
    assert got == {(2, 2, "a"): 1, (0, 0, "a"): 1, (0, 3, "a"): 1, (3, 3, "b"): 1}
    same = {(r.x, r.y, r.c): r.n_features for r in point_tile_rollup(df, "lon", "lat", 2, "c", buffer=1e-12).collect()}
    assert {k: v for k, v in same.items() if k in got} == got


def test_box_tiles_with_buffer(spark):
    df = spark.createDataFrame([(-10.0, -10.0, 10.0, 10.0, "a"), (-1.0, 1.0, -0.5, 2.0, "a"), (-180.0, -85.0, 180.0, 85.0, "w")], "x0 double, y0 double, x1 double, y1 double, c string")
    b = Box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    got = {(r.x, r.y, r.c): r.n_features for r in tile_rollup(df, b, 1, "c").collect()}
    assert got == {(0, 0, "a"): 2, (0, 1, "a"): 1, (1, 0, "a"): 1, (1, 1, "a"): 1, **{(x, y, "w"): 1 for x in (0, 1) for y in (0, 1)}}
    wide = {(r.x, r.y): r.n_features for r in tile_rollup(df.filter("x1 = -0.5"), b, 1, "c", buffer=0.25).collect()}
    assert wide == {(0, 0): 1, (1, 0): 1, (0, 1): 1, (1, 1): 1}


def test_boxes_against_brute_force(spark):
    """Narrow and wide boxes, copies, boxes over the date line by a buffer, and a category that is null."""
    rng = random.Random(5)
    rows = [(x, y, x + rng.uniform(0, 60), y + rng.uniform(0, 30), rng.choice(["a", "b", None])) for x, y in ((rng.uniform(-180, 120), rng.uniform(-80, 50)) for _ in range(60))]
    rows += rows[:20] + [(-180.0, -85.0, 180.0, 85.0, "a"), (179.9, 1.0, 180.0, 2.0, "b")]
    df = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double, c string")
    b = Box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    for z, buffer in ((5, 0.0), (5, 0.3), (2, 0.25)):
        size, want = 2**z, {}
        tile_y = lambda lat: 0.5 - 0.25 * math.log((1 + math.sin(math.radians(lat))) / (1 - math.sin(math.radians(lat)))) / math.pi
        for x0, y0, x1, y1, c in rows:
            first, last = (math.floor((v / 360 + 0.5) * size + s * buffer) for v, s in ((x0, -1), (x1, 1)))
            top, bottom = (math.floor(tile_y(v) * size + s * buffer) for v, s in ((y1, -1), (y0, 1)))
            for x in range(first, min(last, first + size - 1) + 1):
                for y in range(max(top, 0), min(bottom, size - 1) + 1):
                    want[x % size, y, c] = want.get((x % size, y, c), 0) + 1
        got = tile_rollup(df, b, z, "c", buffer)
        assert {(r.x, r.y, r.c): r.n_features for r in got.collect()} == want
    # One scan of the features, and as many rows before the last step as ranges have rows of tiles.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


# --- clusters -------------------------------------------------------------------------------


def test_clusters(spark):
    rows = [(i, 10.0 + i * 1e-7, 20.0, 1 + i) for i in range(5)] + [(9, -60.0, 0.0, 2), (10, 50.0, 0.0, 1), (11, 50.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "point_id bigint, lon double, lat double, w int")
    plain = {r.first_id: r for r in cluster_rollup(df, 5).collect()}
    assert {k: (r.is_cluster, r.point_count) for k, r in plain.items()} == {0: (True, 5), 9: (False, 1), 10: (True, 2)}
    assert math.isclose(plain[0].lon, 10.0 + 2e-7, abs_tol=1e-9) and math.isclose(plain[0].lat, 20.0, abs_tol=1e-9)

    weighted = {r.first_id: r for r in cluster_rollup(df, 5, weight="w", reduce={"heaviest": F.max("w")}).collect()}
    assert weighted[0].point_count == 15 and weighted[0].heaviest == 5
    assert math.isclose(weighted[0].lon, 10.0 + 1e-7 * (0 + 2 + 6 + 12 + 20) / 15, abs_tol=1e-9)
    assert (weighted[9].is_cluster, weighted[9].point_count) == (False, 2)

    larger = {r.first_id: (r.is_cluster, r.point_count) for r in cluster_rollup(df, 5, min_points=3).collect()}
    assert larger == {0: (True, 5), 9: (False, 1), 10: (False, 1), 11: (False, 1)}


def test_no_cluster_row_is_lost(spark):
    """Weights that do not reach a cluster, without weight, fractions and equal rows."""
    rows = [(0, 1.0, 1.0, 0.0), (1, 1.0, 1.0, 1.0), (2, -9.0, 5.0, None), (3, 70.0, 5.0, 0.75), (4, 70.0, 5.0, 0.75), (4, 70.0, 5.0, 0.75)]
    df = spark.createDataFrame(rows, "point_id bigint, lon double, lat double, w double")
    got = sorted((r.first_id, r.is_cluster, r.point_count) for r in cluster_rollup(df, 5, weight="w").collect())
    assert got == [(0, False, 0.0), (1, False, 1.0), (2, False, 0.0), (3, True, 2.25)]
    copies = sorted((r.first_id, r.is_cluster) for r in cluster_rollup(df.filter("point_id = 4"), 5, min_points=3).collect())
    assert copies == [(4, False), (4, False)]


def test_ids_that_repeat(spark):
    square, triangle = [[box(0.0, 0.0, 10.0, 10.0)]], [[closed([[20.0, 0.0], [30.0, 0.0], [20.0, 10.0]])]]
    polygons = spark.createDataFrame([(7, 0, square), (7, 1, triangle)], POLYGONS)
    points = spark.createDataFrame([(1, 8.0, 8.0), (1, 50.0, 50.0), (2, 8.0, 8.0), (2, 8.0, 8.0), (3, 21.0, 1.0), (4, None, 1.0)], POINTS)
    pairs = sorted((r.point_id, r.polygon_id) for r in points_within(points, polygons).collect())
    assert pairs == [(1, 7), (2, 7), (2, 7), (3, 7)]
    flags = sorted((r.point_id, r.within) for r in within_any(points, polygons).collect())
    assert flags == [(1, False), (1, True), (2, True), (2, True), (3, True), (4, False)]
    assert sorted(r.point_id for r in hit_test(points, polygons).collect()) == [1, 2, 3]
    plan = points_within(points, polygons)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_plain_lines_are_decided_in_the_row_of_the_pair(spark):
    """Lines and polygons by the hundred: no pair is grouped or joined again, so no pair is shuffled."""
    square = lambda x, y, r: [[[[x - r, y - r], [x + r, y - r], [x + r, y + r], [x - r, y + r], [x - r, y - r]]]]
    polygons = [(i, square(10 + i * 0.01, 20.0, 0.5)) for i in range(100)]
    lines = [(i, [[[10 + i * 0.01, 20.0], [10.02 + i * 0.01, 20.01]]]) for i in range(100)]
    lines += [(100, [[[10.0, 20.0], None]]), (101, [[[10.0, 20.0]]])]
    a = spark.createDataFrame(lines, "line_id long, paths array<array<array<double>>>")
    b = spark.createDataFrame(polygons, "polygon_id long, rings array<array<array<array<double>>>>")
    got = lines_within(a, b)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "sha2" not in plan and plan.count("Join") == 1
    want = set()
    for i, [path] in lines[:100] + lines[101:]:
        for j, [[ring]] in polygons:
            if all(ring[0][0] < x < ring[1][0] and ring[0][1] < y < ring[2][1] for x, y in path):
                want.add((i, j))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_dense_lines_need_no_descent(spark, monkeypatch):
    """Points inside, in gaps and far outside of lines that overlap many times."""

    def descended(*_):
        raise AssertionError("descended")

    monkeypatch.setattr(nearest_module, "_descended", descended)
    rng = random.Random(3)
    lines = []
    for i in range(600):
        x, y = rng.uniform(0, 1), rng.uniform(0, 1)
        if not (0.4 < x < 0.6 and 0.4 < y < 0.6):
            lines.append((i, [[[x, y], [x + rng.uniform(-0.1, 0.1), y + rng.uniform(-0.1, 0.1)]]]))
    points = [(i, rng.uniform(-0.3, 1.3), rng.uniform(-0.3, 1.3)) for i in range(300)]
    a = spark.createDataFrame(points, "point_id long, lon double, lat double")
    b = spark.createDataFrame(lines, "line_id long, paths array<array<array<double>>>")
    got = {r.point_id: (r.target_id, r.metres) for r in nearest_module.nearest_line(a, b).collect()}
    edges = spark.createDataFrame([(i, (*p, *q)) for i, [[p, q]] in lines], "target_id long, e struct<x1:double,y1:double,x2:double,y2:double>")
    kx, ky = geo.metres_per_degree(F.col("lat"))
    apart = a.crossJoin(edges).withColumn("metres", geo.segment_metres(kx, ky, F.col("lon"), F.col("lat"), F.col("e")))
    best = apart.groupBy("point_id").agg(F.min(F.struct("metres", "target_id")).alias("b"))
    want = {r.point_id: (r.b.target_id, r.b.metres) for r in best.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], rel_tol=1e-9, abs_tol=1e-9)


def test_points_in_polygons_have_no_edge_to_look_for(spark, monkeypatch):
    """Edges are looked up for points at some distance only; on an edge of a lower id is nearer than inside a higher one."""
    looked = []
    search = nearest_module._nearest_segment
    monkeypatch.setattr(nearest_module, "_nearest_segment", lambda located, segments: looked.append(located.count()) or search(located, segments))
    square = lambda x, y, r: [[[[x - r, y - r], [x + r, y - r], [x + r, y + r], [x - r, y + r], [x - r, y - r]]]]
    polygons = [(1, square(0.0, 0.0, 1.0)), (2, square(1.0, 0.0, 0.5)), (None, square(8.0, 0.0, 1.0))]
    points = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.25, 0.0), (4, 3.0, 0.0), (5, 8.0, 0.0)]
    a = spark.createDataFrame(points, "point_id long, lon double, lat double")
    b = spark.createDataFrame(polygons, "polygon_id long, rings array<array<array<array<double>>>>")
    got = {r.point_id: (r.target_id, r.metres == 0) for r in nearest_module.nearest_polygon(a, b).collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (2, True), 4: (2, False), 5: (None, True)}
    assert looked == [1]


def joins(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "Build" in line or "SortMergeJoin" in line]


def test_pairs_of_few_corners_are_joined_without_lambdas(spark):
    """The loop of the join is compiled: the lists of other polygons and lines are looked at in steps after it, or in joins of their own."""
    diamond = lambda x, y, r: [[closed([[x - r, y], [x, y - r], [x + r, y], [x, y + r]])]]
    polygons = spark.createDataFrame([(i, i, diamond(i * 0.1, 0.0, 0.3)) for i in range(30)], POLYGONS)
    points = spark.createDataFrame([(i, i * 0.05, 0.01) for i in range(60)], POINTS)
    lines = spark.createDataFrame([(i, [[[i * 0.1, 0.0], [i * 0.1 + 0.05, 0.05], [i * 0.1, 0.1]]]) for i in range(30)], LINES)
    for found in (points_within(points, polygons), lines_within(lines, polygons), hit_test(points, polygons)):
        assert joins(found) and not any("lambda" in line for line in joins(found))
    want = {(p, g) for p in range(60) for g in range(30) if abs(p * 0.05 - g * 0.1) + 0.01 < 0.3}
    assert {(r.point_id, r.polygon_id) for r in points_within(points, polygons).collect()} == want
    firsts = {p: min(g for q, g in want if q == p) for p, _ in want}
    assert {r.point_id: r.polygon_id for r in hit_test(points, polygons).collect()} == firsts


def test_few_corners_flat_edges_and_more_corners_together(spark):
    """Boxes, whose edges are flat, a triangle, one corner only, and a ring of more corners, on and beside the borders of cells."""
    polygons = [(1, 1, [[box(0.0, 0.0, 4.0, 4.0)]]), (2, 2, [[closed([[0.0, 0.0], [8.0, 0.0], [0.0, 8.0]])]]), (3, 3, [[[[1.0, 1.0]]]]), (4, 4, [[star(random.Random(2), 3.0, 3.0, 2.0, 9)]]), (None, 5, [[box(2.0, 2.0, 3.0, 3.0)]])]
    points = [(i, x / 8, y / 8) for i, (x, y) in enumerate((x, y) for x in range(-2, 40, 3) for y in range(-2, 40, 3))]
    want = sorted((p, g or -1) for p, x, y in points for g, _, parts in polygons if strictly(x, y, parts[0][0]))
    got = points_within(spark.createDataFrame(points, POINTS), spark.createDataFrame(polygons, POLYGONS)).collect()
    assert sorted((r.point_id, r.polygon_id or -1) for r in got) == want


def strictly(x, y, ring):
    on = any((bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by) for (ax, ay), (bx, by) in zip(ring, ring[1:]))
    return len(ring) > 1 and not on and winding_inside(x, y, [ring])


def test_next_to_an_edge_is_on_its_line(spark):
    """The box of a slanted edge is not next to the edge, so that no distance is taken there."""
    edge = {"x1": F.lit(0.0), "y1": F.lit(0.0), "x2": F.lit(1.0), "y2": F.lit(1.0)}
    rows = spark.createDataFrame([(0.5, 0.5), (0.5, 0.75), (1.0, 1.0), (1.1, 1.1), (0.25, 0.25 + 1e-10)], "x double, y double")
    assert [r.near for r in rows.select(nearest_module._near_edge(F.col("x"), F.col("y"), edge).alias("near")).collect()] == [True, False, True, False, True]


def test_dense_spans_have_a_finer_grid():
    """Lines that overlap a great many times: a cell has a few hundred, not a thousand."""
    n, length = 10_800_000, 216_000
    grid = nearest_module.Grid.of(nearest_module.Frame.of(0.0, 1.0, 0.0, 1.0), n, length)
    assert (n + 2**grid.level * length) / 4**grid.level < 256
