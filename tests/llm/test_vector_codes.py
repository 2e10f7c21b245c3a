"""Codes and codebooks against plain loops over all entries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts, entries, rounds, scale):
    own = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) and abs(scale * x) < 2**63 for x in v)]
    dims = -(-max((len(v) for _, v, _ in own), default=0) // parts) * parts
    own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = dims // parts
    cut = [[(v + [0] * (dims - len(v)))[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in own]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            by = {}
            for c in cut:
                by.setdefault(near(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(by[k]) for x in zip(*by[k])] if k in by else e for k, e in enumerate(books[p])]
    out = [(i, label, [near(p, c[p])[1] for p in range(parts)], sum(near(p, c[p])[0] for p in range(parts))) for (i, _, label), c in zip(own, cut)]
    totals = {}
    for _, label, _, error in out:
        totals[label] = totals.get(label, 0) + error
    return sorted(((i, codes, min(error, V.MOST), min(totals[label], V.MOST)) for i, label, codes, error in out), key=repr), books


def check(spark, rows, parts=4, entries=16, rounds=3, scale=64):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("codes", "error", "_v", "_label", "part", "n")})
    codes, codec = V.compress(frame, parts=parts, entries=entries, rounds=rounds, scale=scale)
    want, books = brute(rows, parts, entries, rounds, scale)
    assert sorted(((r["vec_id"], list(r["codes"]), r["error"], r["label_error"]) for r in codes.collect()), key=repr) == want
    assert codec.text() == ",".join(str(x) for book in books for entry in book for x in entry)


@pytest.mark.parametrize("seed, dims, spread", [(1, 8, 1.0), (2, 16, 0.05), (3, 12, 0.02)])
def test_matches_brute_force(spark, seed, dims, spread):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, spread, (150, dims)).round(2)  # few different components: many ties
    v[::4] = v[0]
    rows = [(int(i), [float(x) for x in row], [None, 1, 2][int(i) % 3]) for i, row in zip(rng.permutation(600)[:150], v)]
    rows += [(1000, None, 1), (1001, [0.1, None] * (dims // 2), 1), (1002, [math.nan] * dims, 1), (1003, [math.inf] * dims, None), (None, [0.5] * dims, 1), rows[0], rows[0], (rows[1][0], rows[2][1], 1)]
    check(spark, rows)


def test_trees_find_the_lowest_of_equal_entries():
    rng = np.random.default_rng(4)
    for _ in range(20):
        entries = rng.integers(-3, 4, (rng.integers(1, 300), 4))
        points = rng.integers(-4, 5, (200, 4))
        at, far = V.Tree(entries).nearest(points)
        every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (at == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def test_large_components_and_lengths(spark):
    rows = [(i, [(-1.0) ** i * 1e14 + i * 1e10, 3.0 * i, 5.0], i % 2) for i in range(40)] + [(50, [], 1), (51, [1e300], 1), (52, [2.0], None)]
    check(spark, rows)
    check(spark, [(i, [], 1) for i in range(3)])
    check(spark, [(7, [1.0, 2.0, 3.0, 4.0], None)])
    check(spark, [(1, None, 1)])


def test_empty_and_decoding(spark):
    frame = spark.createDataFrame([(i, [i / 8, -i / 8], 1) for i in range(10)], SCHEMA)
    assert V.compress(frame.limit(0))[0].count() == 0
    codes, codec = V.compress(frame, parts=2)
    got = {r["vec_id"]: list(r["vector"]) for r in V.decode(codes, codec).collect()}
    assert got == {i: [(i * 128 + 0.5) / 1024, (-i * 128 + 0.5) / 1024] for i in range(10)}
    with pytest.raises(ValueError):
        V.compress(frame, entries=0)
