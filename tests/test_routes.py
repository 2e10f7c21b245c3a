"""Ways and alignments against Dijkstra's algorithm and a direct search."""

import heapq
import math
import random

import numpy as np
import pytest

from terrane.operators import alignment, routes


def dijkstra(edges, start, goal):
    costs, todo = {start: 0.0}, [(0.0, start)]
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    while todo:
        cost, node = heapq.heappop(todo)
        if node == goal:
            return cost
        if cost > costs[node]:
            continue
        for b, w in out.get(node, ()):
            if cost + w < costs.get(b, math.inf):
                costs[b] = cost + w
                heapq.heappush(todo, (cost + w, b))
    return None


@pytest.mark.parametrize("seed, marks, delta", [(1, 3, None), (2, 1, 0.4)])
def test_ways_are_as_cheap_as_dijkstras(spark, seed, marks, delta):
    rng = random.Random(seed)
    places = [(rng.random(), rng.random()) for _ in range(120)]
    edges = [(i, j, rng.uniform(1, 1.5) * math.dist(a, b)) for i, a in enumerate(places) for j, b in enumerate(places) if i != j and math.dist(a, b) < 0.25 and rng.random() < 0.8]
    edges += [(500, 501, 1.0), (501, 502, 1.0), (502, 500, 0.25)]  # a part of its own
    pairs = [(k, rng.randrange(120), rng.randrange(120)) for k in range(12)] + [(100, 500, 502), (101, 502, 501), (102, 3, 500), (103, 7, 7), (104, 999, 3), (105, 3, 999)]
    got = routes.routes(spark.createDataFrame(edges, "src long, dst long, cost double"), spark.createDataFrame(pairs, "pair int, start long, goal long"), marks, delta).collect()
    weight = {(a, b): w for a, b, w in edges}
    want = {k: c for k, a, b in pairs if (c := dijkstra(edges, a, b)) is not None}
    assert {r["pair"] for r in got} == set(want)
    ends = {k: (a, b) for k, a, b in pairs}
    for r in got:
        assert r["cost"] == pytest.approx(want[r["pair"]], abs=1e-12)
        assert (r["path"][0], r["path"][-1]) == ends[r["pair"]]
        assert sum(weight[step] for step in zip(r["path"], r["path"][1:])) == pytest.approx(r["cost"], abs=1e-12)


def test_kinds_of_road_weigh(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, "track"), (2, 3.0, 4.0, "tertiary"), (3, 3.0, 0.0, "path")], "id long, x double, z double, kind string")
    got = {(r["src"], r["dst"]): r["cost"] for r in routes.road_costs(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), nodes).collect()}
    assert got == pytest.approx({(1, 2): 4.0, (2, 1): 8.0, (2, 3): 4.0, (3, 2): 3.2})


def test_a_turned_figure_is_found(spark):
    rng = np.random.default_rng(5)
    own, other, want = [], [], {}
    for figure, turn in ((1, 31.5), (2, -128.0), (3, 88.0)):
        corner = [(x * 0.2 + 0.1, z * 0.2 + 0.1) for x in range(40) for z in range(25) if not (x > 20 and z > 10)]
        own += [(figure, *p) for p in corner]
        c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        fine = rng.uniform(0, 1, (60_000, 2)) * (8, 5)
        fine = fine[~((fine[:, 0] > 4.2) & (fine[:, 1] > 2.2))]
        cells = {(math.floor((x * c - z * s) / 0.2), math.floor((x * s + z * c) / 0.2)) for x, z in fine}
        other += [(figure, *p) for p in cells]
        want[figure] = turn
    base = spark.createDataFrame([(f, t + 90 + 2.5) for f, t in want.items()], "figure int, base double")
    got = alignment.aligned(spark.createDataFrame(own, "figure int, x double, z double"), spark.createDataFrame(other, "figure int, ix long, iz long"), "figure", base, 0.2, 2).collect()
    assert {r["figure"] for r in got} == set(want)
    for r in got:
        assert abs((r["theta"] - want[r["figure"]] + 180) % 360 - 180) <= 2.0 and abs(r["dx"]) <= 1 and abs(r["dz"]) <= 1
        assert r["iou"] > 0.75 > r["second"] and r["confidence"] == ("high" if r["iou"] > 0.8 and r["iou"] - r["second"] > 0.1 else "medium")
