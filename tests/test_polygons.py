"""Points, runs and crossings of polygons against edge-by-edge tests."""

import math
import random

import pytest

from terrane.operators import scanline, spatial

EDGE = "poly int, x1 double, z1 double, x2 double, z2 double"


def ring(poly, points):
    return [(poly, *map(float, a), *map(float, b)) for a, b in zip(points, points[1:] + points[:1])]


def inside(edges, x, z):
    return sum((z1 > z) != (z2 > z) and x < (x2 - x1) * (z - z1) / (z2 - z1) + x1 for _, x1, z1, x2, z2 in edges) % 2 == 1


def polygons(seed, snap):
    """Stars with a hole, some of them with corners on a lattice, one that crosses itself."""
    rng = random.Random(seed)
    out = {}
    for poly in range(8):
        cx, cz, n = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.randrange(3, 12)
        star = [(cx + r * math.cos(6.283 * k / n), cz + r * math.sin(6.283 * k / n)) for k in range(n) for r in [rng.uniform(0.5, 6)]]
        points = [(round(x / snap) * snap, round(z / snap) * snap) for x, z in star] if snap else star
        out[poly] = ring(poly, points)
    out[8] = ring(8, [(-4, -4), (4, -4), (4, 4), (-4, 4)]) + ring(8, [(-2, -2), (-2, 2), (2, 2), (2, -2)])
    out[9] = ring(9, [(0, 0), (6, 6), (6, 0), (0, 6)])
    return out


@pytest.mark.parametrize("seed, snap, size", [(1, 0, 0.7), (2, 0.5, 0.5), (3, 1, 1.0), (4, 0, 20.0), (5, 0.25, 0.1)])
def test_points_in_polygons(spark, seed, snap, size):
    polys, rng = polygons(seed, snap), random.Random(seed)
    points = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(300)] + [(1000 + i, (i % 33 - 16) / 4, (i // 33 - 16) / 4) for i in range(33 * 33)]
    points += [(9000, math.nan, 0.0), (9001, math.inf, 0.0), (9002, None, 1.0)]
    got = spatial.points_in_polygons(spark.createDataFrame(points, "id long, x double, z double"), "id", spark.createDataFrame([e for es in polys.values() for e in es], EDGE), "poly", size)
    want = {(i, p) for i, x, z in points[:-3] for p, edges in polys.items() if inside(edges, x, z)}
    rows = [(r["id"], r["poly"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("seed, snap", [(6, 0), (7, 0.5)])
def test_runs_hold_the_middles_inside(spark, seed, snap):
    polys = polygons(seed, snap)
    made = scanline.runs(spark.createDataFrame([e for es in polys.values() for e in es], EDGE), "poly", 0.5)
    got = [(r["poly"], r["ix"], r["iz"]) for r in scanline.cells(made, "poly").collect()]
    want = {(p, ix, iz) for p, edges in polys.items() for ix in range(-40, 40) for iz in range(-40, 40) if inside(edges, 0.25 + ix * 0.5, 0.25 + iz * 0.5)}
    assert len(got) == len(set(got)) and set(got) == want


def test_aligned_pieces_cover_each_run_once(spark):
    rng = random.Random(8)
    rows = [(i, a, a + rng.randrange(0, 3000)) for i, a in enumerate([0, 1, -1, -7, 5, 1023, -1024] + [rng.randrange(-5000, 5000) for _ in range(120)])]
    rows += [(1000 + k, k, k + n) for k in range(-4, 5) for n in range(9) for k in [k]]
    frame = spark.createDataFrame([(j, a, b) for j, (_, a, b) in enumerate(rows)], "id int, from_ix long, to_ix long")
    found = {}
    for r in scanline.aligned(frame).collect():
        found.setdefault(r["id"], []).extend(range(r["_index"] << r["_level"], (r["_index"] + 1) << r["_level"]))
    for j, (_, a, b) in enumerate(rows):
        assert sorted(found[j]) == list(range(a, b + 1))
    assert scanline.aligned(frame).count() < 2 * 13 * len(rows)


def test_what_is_handled_grows_with_the_border(spark):
    wide = 10_000
    corners = [(0, 0), (wide, 1234.5), (wide - 500, wide), (3000, wide - 100), (10, 6000)]
    edges, rng = ring(1, corners), random.Random(9)
    frame = spark.createDataFrame(edges, EDGE)
    made = scanline.runs(frame, "poly", 1.0)
    assert made.count() < 1.1 * wide  # some 60 million cells lie inside
    assert scanline.aligned(made).count() < 30 * wide
    assert spatial._segment_cells(frame, 1.0, 0.0).count() < 10 * wide
    points = [(i, rng.uniform(0, wide), rng.uniform(0, wide)) for i in range(3000)]
    got = spatial.points_in_polygons(spark.createDataFrame(points, "id long, x double, z double"), "id", frame, "poly", 1.0)
    assert {r["id"] for r in got.collect()} == {i for i, x, z in points if inside(edges, x, z)}


def test_self_crossings_by_cell(spark):
    rng = random.Random(10)
    points = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(40)]
    rows = [(1, i, *e[1:], 40) for i, e in enumerate(ring(1, points))]

    def side(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def cross(p, q):
        a, b, c, d = p[2:4], p[4:6], q[2:4], q[4:6]
        return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0

    want = {(i, j) for i in range(40) for j in range(i + 2, 40) if (i, j) != (0, 39) and cross(rows[i], rows[j])}
    got = spatial.self_crossings(spark.createDataFrame(rows, "ring int, i int, x1 double, z1 double, x2 double, z2 double, n int"), "ring", "i", "n", 0.8).collect()
    assert len(got) == len(want) and {(r["i"], r["j"]) for r in got} == want
