"""Rings from shuffled ways, nesting, and clipped lines."""

import random

from terrane.operators import multipolygons, spatial


def cut(rng, ring):
    """A ring of nodes as ways between some of its nodes, in either direction."""
    cuts = sorted(rng.sample(range(len(ring)), rng.randrange(1, len(ring))))
    ways = []
    for a, b in zip(cuts, cuts[1:] + [cuts[0] + len(ring)]):
        way = [ring[k % len(ring)] for k in range(a, b + 1)]
        ways.append(way[::-1] if rng.random() < 0.5 else way)
    return ways


def normal(nodes):
    """A ring from its least node, in the direction of the smaller neighbour."""
    k = nodes.index(min(nodes))
    turned = nodes[k:] + nodes[:k]
    return tuple(min(turned, [turned[0]] + turned[:0:-1]))


def test_rings_of_many_ways(spark):
    rng, rows, want, node = random.Random(1), [], {}, 0
    for rel in range(12):
        for role in ("inner", "outer"):
            ways = []
            for _ in range(rng.randrange(0, 4)):
                ring = list(range(node, node + rng.choice([1, 2, 3, 4, 9, 70])))
                node += len(ring)
                if len(ring) == 1:
                    continue
                ways += cut(rng, ring)
                if len(ring) >= 3:
                    want.setdefault((rel, role), set()).add(normal(ring))
            ways.append([node, node + 1, node + 2])  # an open chain
            ways.append([node + 2, node + 3])
            node += 4
            rng.shuffle(ways)
            rows += [(rel, role, k, way) for k, way in enumerate(ways)]
    frame = spark.createDataFrame(rows, "rel int, role string, way int, nodes array<long>").repartition(5)
    found = {}
    for r in sorted(multipolygons.stitched(frame, ["rel", "role"]).collect(), key=lambda r: r["i"]):
        found.setdefault((r["rel"], r["role"], r["ring"]), []).append((r["i"], r["node"]))
    got = {}
    for (rel, role, _), points in found.items():
        assert [i for i, _ in points] == list(range(len(points)))
        got.setdefault((rel, role), set()).add(normal([n for _, n in points]))
    assert got == want
    for key in got:
        assert sorted(k[2] for k in found if k[:2] == key) == list(range(len(got[key])))


def test_a_ring_starts_with_its_smallest_way(spark):
    ways = [(1, 5, [3, 4, 9]), (1, 2, [3, 2, 1]), (1, 7, [9, 1]), (1, 8, [20, 21, 22, 20]), (1, 9, [30, 31, 30])]
    got = multipolygons.stitched(spark.createDataFrame(ways, "rel int, way int, nodes array<long>"), ["rel"]).collect()
    assert sorted((r["ring"], r["i"], r["node"]) for r in got) == [(0, 0, 3), (0, 1, 2), (0, 2, 1), (0, 3, 9), (0, 4, 4), (1, 0, 20), (1, 1, 21), (1, 2, 22)]
    assert multipolygons.stitched(spark.createDataFrame([], "rel int, way int, nodes array<long>"), ["rel"]).count() == 0


def test_inner_rings_find_the_smallest_ring_around(spark):
    square = lambda key, ring, c, r: [(key, ring, i, c + dx * r, c + dz * r) for i, (dx, dz) in enumerate(((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)))]
    schema = "rel int, ring int, i int, x double, z double"
    outer = spark.createDataFrame(square(1, 0, 0.0, 10.0) + square(1, 1, 0.0, 5.0) + square(1, 2, 50.0, 5.0) + square(2, 0, 0.0, 4.0), schema)
    inner = spark.createDataFrame(square(1, 7, 0.0, 2.0) + square(1, 8, 7.5, 1.0) + square(1, 9, 90.0, 1.0) + square(2, 7, 0.0, 1.0), schema)
    got = {(r["rel"], r["ring"], r["around"]) for r in multipolygons.nested(inner, outer, "rel", 1.0).collect()}
    assert got == {(1, 7, 1), (1, 8, 0), (2, 7, 0)}


def test_clipped_lines(spark):
    edges = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (1, 10.0, 0.0, 10.0, 10.0), (1, 10.0, 10.0, 0.0, 10.0), (1, 0.0, 10.0, 0.0, 0.0)], "poly int, x1 double, z1 double, x2 double, z2 double")
    lines = {1: [(-5, 5), (5, 5), (6, 5), (15, 5), (20, 5)], 2: [(-5, 20), (20, 20)], 3: [(-5, 5), (15, 5)], 4: [(12, 12), (10.5, 10.2), (30, 30)], 5: [(1, 1), (2, 2), (40, 2), (41, 2), (42, 5), (9, 5), (8, 5)]}
    points = spark.createDataFrame([(line, i, float(x), float(z)) for line, pts in lines.items() for i, (x, z) in enumerate(pts)], "line int, i int, x double, z double")
    got = {}
    for r in spatial.clipped_lines(points, "line", edges, "poly", 1.0, 2.0).collect():
        got.setdefault((r["line"], r["run"]), set()).add(r["i"])
    assert got == {(1, 0): {0, 1, 2, 3}, (3, 0): {0, 1}, (5, 0): {0, 1, 2}, (5, 1): {4, 5, 6}}
