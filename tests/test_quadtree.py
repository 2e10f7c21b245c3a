"""Nearest neighbours against all distances."""

import math
import random

import pytest
from terrane.operators import quadtree

SCHEMA = "id long, x double, z double"


def brute(left, right, k, apart):
    out = set()
    for i, x, z in left:
        near = sorted((math.sqrt((x - a) * (x - a) + (z - b) * (z - b)), j) for j, a, b in right if not (apart and i == j))[:k]
        out |= {(i, r + 1, j) for r, (_, j) in enumerate(near)}
    return out


def points(seed, n, kind):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, z = rng.uniform(-10, 10), rng.uniform(-3, 3)
        if kind == "crowded" and i % 3 == 0:
            x, z = 5 + rng.gauss(0, 1e-5), 1 + rng.gauss(0, 1e-5)
        if kind == "lattice":
            x, z = float(round(x)), float(round(z))
        if kind == "copies" and i % 3 == 0:
            x, z = 2.5, -1.25
        out.append((i, x, z))
    rng.shuffle(out)
    return out


def check(spark, left, right, k, apart, **options):
    named = spark.createDataFrame(right, SCHEMA).withColumnRenamed("id", "other").repartition(3)
    got = quadtree.nearest(spark.createDataFrame(left, SCHEMA).repartition(3), "id", named, "other", k, apart, **options).collect()
    finite = lambda rows: [r for r in rows if None not in r and all(map(math.isfinite, r[1:]))]
    assert len(got) == len({(r["id"], r["rank"]) for r in got})
    assert {(r["id"], r["rank"], r["other"]) for r in got} == brute(finite(left), finite(right), k, apart)


@pytest.mark.parametrize("kind, k", [("crowded", 2), ("lattice", 3), ("copies", 4)])
def test_of_a_table_with_itself(spark, kind, k):
    rows = points(1, 400, kind)
    check(spark, rows, rows, k, True, capacity=8)


def test_of_other_places_near_and_far(spark):
    rng = random.Random(2)
    asking = [(i, rng.uniform(-40, 40), rng.uniform(-40, 40)) for i in range(60)] + [(100, 1e6, -1e6), (101, math.nan, 0.0), (102, None, 1.0), (103, 5.0, 1.0), (104, math.inf, 0.0)]
    check(spark, asking, points(3, 300, "crowded"), 2, False, capacity=8)
    check(spark, asking, points(4, 3, "even"), 5, False)
    check(spark, asking, [(i, 1.5, 2.5) for i in range(90)], 3, False)
    check(spark, asking, [(1, math.nan, 1.0)], 3, False)


def test_a_crowded_spot_is_split(spark):
    rows = spark.createDataFrame(points(5, 3000, "crowded"), SCHEMA)
    square = quadtree.Square(-10.0, -10.0, 20.0)
    tree = quadtree.nodes(square.coded(rows), 16)
    leaves = tree.where("_n <= 16").toPandas()
    assert leaves["_n"].sum() == 3000 and tree.where("_n > 16 AND _level = 24").count() == 0
    assert leaves["_level"].max() > 15 > 6 > leaves["_level"].min()
    assert tree.count() < 3000
