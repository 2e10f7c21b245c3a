"""Exact top-k against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k):
    own = []
    for vec_id, v, _ in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((vec_id, np.array([math.floor(256 * float(np.float32(x))) for x in v], dtype=object)))
    out = []
    for q, v in own:
        if is_query(q):
            scores = sorted((-int((v * w).sum()), c) for c, w in own if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    return sorted(out)


def rows_of(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.2, (n, 8)).round(2)
    base[n // 2 :: 7] = base[3]  # many copies
    rows = [(int(i), [float(x) for x in v], 1) for i, v in zip(rng.permutation(5 * n)[:n], base)]
    return rows + [(10**6, None, 1), (10**6 + 5, [0.1, None] * 4, 1), (10**6 + 10, [float("nan")] * 8, 1), (10**6 + 15, [float("inf")] + [0.0] * 7, 1), (None, [0.5] * 8, 1), (10**6 + 20, [0.0] * 8, 1)]


@pytest.mark.parametrize("seed, slices", [(1, 2), (2, 3), (3, 1)])
def test_matches_brute_force(spark, monkeypatch, seed, slices):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 9)
    rows = rows_of(seed, 200)
    got = topk.search(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 5 == 0, 5, slices)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, lambda i: i % 5 == 0, 5)


def test_cases(spark):
    few = [(0, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (3, [-1.0, 0.5], 1), (3, [-1.0, 0.5], 1)]
    frame = spark.createDataFrame(few, SCHEMA)
    got = topk.search(frame, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(few[:3], lambda i: i % 50 == 0, 5)
    assert topk.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(frame, F.lit(False)).count() == 0
    assert topk.search(frame.limit(1), F.lit(True)).count() == 0


def test_ties_repeated_rows_and_clashing_names(spark):
    rows = [(i, [1.0, 0.0], 1) for i in (7, 5, 0, 50, 12, 12, 3, 9, 100)] + [(20, [0.0, 1.0], 1), (21, [0.5, 0.0], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("class", "q", "cb", "rank", "score")})
    got = topk.search(frame, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(list(dict.fromkeys((i, tuple(v), x) for i, v, x in rows)), lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("size", [100.0, 1e6, 1e12, 3e15, 2.0**54])
def test_large_components_are_exact(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, size, 4)], 1) for i in range(30)] + [(30, [3e38, 0.0, 0.0, 0.0], 1)]
    rows = [r for r in rows if max(map(abs, r[1])) < 2**55 or r[0] == 30]
    got = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0)
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    own = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i != 30}
    want = []
    for q in own:
        if q % 5 == 0:
            best = sorted((-clip(sum(a * b for a, b in zip(own[q], own[c]))), c) for c in own if c != q)[:5]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
