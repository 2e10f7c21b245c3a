"""Overlapping faces, doubled and floating objects."""

import random

from terrane.operators import faces

CORNERS = ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz")


def triangles(spark, rows):
    return spark.createDataFrame([(i, owner, *[float(v) for p in corners for v in p]) for i, owner, corners in rows], f"id long, owner int, {CORNERS}")


def pairs(rows):
    return {(r["a"], r["b"]) for r in rows.collect()}


def test_pairs_in_one_plane(spark):
    flat = lambda x, z, y=0.0, s=1.0: [(x, y, z), (x + s, y, z), (x, y, z + s)]
    rows = [
        (1, 1, flat(0, 0)), (2, 2, flat(0.3, 0.3)), (3, 3, flat(0.3, 0.3, 0.005)), (4, 4, flat(0.3, 0.3, 0.5)),  # in it, nearly, above
        (5, 1, flat(0.2, 0.2)),  # of the same owner
        (6, 6, flat(1.0, 0.0)), (7, 7, flat(0.6, 0.6)),  # beside, along an edge and beyond it
        (8, 8, [(0, -0.5, 0.2), (1, -0.5, 0.2), (0, 0.5, 0.2)]),  # across
        (9, 9, flat(0.3, 0.3)[::-1]),  # turned over
        (10, 10, flat(5, 5)), (11, 11, [(5, 0, 5)] * 3), (12, 12, [(5, 0, 5), (float("nan"), 0, 5), (5, 0, 6)]),
    ]
    spots = {1: (0, 0), 2: (0.3, 0.3), 3: (0.3, 0.3), 5: (0.2, 0.2), 6: (1.0, 0.0), 7: (0.6, 0.6), 9: (0.3, 0.3)}
    want = {(i, j) for i, (x, z) in spots.items() for j, (u, v) in spots.items() if i < j and max(x, u) + max(z, v) < 1 + min(x + z, u + v)} - {(1, 5)}
    assert pairs(faces.coplanar_overlaps(triangles(spark, rows))) == want
    assert (1, 2) in want and (1, 7) not in want and (1, 6) not in want


def test_tilted_planes_of_many_faces(spark):
    rng = random.Random(1)
    up = lambda x, z: 0.4 * x - 1.3 * z + 2
    rows, spots = [], {}
    for i in range(150):
        x, z = rng.uniform(-4, 4), rng.uniform(-4, 4)
        lift = rng.choice([0, 0, 3.0])
        spots[i] = (x, z, lift)
        corners = [(u, up(u, v) + lift, v) for u, v in ((x, z), (x + 0.5, z), (x, z + 0.5))]
        rng.shuffle(corners)
        rows.append((i, i, corners))
    want = set()
    for i, (x, z, lift) in spots.items():
        for j, (u, v, other) in spots.items():
            if i < j and lift == other and max(x, u) + max(z, v) < 0.5 + min(x + z, u + v):
                want.add((i, j))
    assert pairs(faces.coplanar_overlaps(triangles(spark, rows), cell=0.7)) == want


def test_doubled_and_floating(spark):
    things = spark.createDataFrame([(1, "lamp", 0.0, 0.0, 0.0), (2, "lamp", 0.05, 0.0, 0.0), (3, "bench", 0.0, 0.0, 0.0), (4, "lamp", 0.0, 1.0, 0.0)], "id long, kind string, x double, y double, z double")
    assert pairs(faces.doubled(things, "kind", 0.1)) == {(1, 2)}
    ground = spark.createDataFrame([(1, 0.0), (2, -1.0), (3, 0.0), (4, 0.0)], "id long, h double")
    table = spark.createDataFrame([(0.1, 0.0, 0.95), (9.0, 9.0, 5.0)], "x double, z double, top double")
    got = {r["id"]: r["gap"] for r in faces.floating(things, table, ground, 0.2, 0.5).collect()}
    assert got == {2: 1.0}
