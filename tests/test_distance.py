"""Nearest cells of a set against all of them."""

import numpy as np
import pytest

from terrane.operators import distance


@pytest.mark.parametrize("seed, w, h, share, x0, z0", [(1, 40, 37, 0.02, 0, 0), (2, 21, 50, 0.3, -7, -30), (3, 60, 5, 0.01, 3, 4), (4, 1, 30, 0.1, 0, 0), (5, 30, 1, 0.1, -2, 9), (6, 20, 20, 0.0, 0, 0)])
def test_transform(spark, seed, w, h, share, x0, z0):
    rng = np.random.default_rng(seed)
    mask = rng.random((h, w)) < share
    cells = spark.createDataFrame([(x + x0, z + z0, bool(mask[z, x])) for x in range(w) for z in range(h)], "ix int, iz int, water boolean").repartition(4)
    got = {(r["ix"], r["iz"]): (r["nx"], r["nz"], r["square"]) for r in distance.transformed(cells, "water").collect()}
    some = sorted((int(x) + x0, int(z) + z0) for z, x in zip(*np.nonzero(mask)))
    for x in range(x0, x0 + w):
        for z in range(z0, z0 + h):
            best = min(((x - a) ** 2 + (z - b) ** 2, a, b) for a, b in some) if some else None
            assert got[x, z] == ((best[1], best[2], best[0]) if best else (None, None, None))
    assert len(got) == w * h


def test_envelope_of_any_heights():
    rng = np.random.default_rng(7)
    for _ in range(200):
        height, known = rng.integers(0, 60, (3, 17)), rng.random((3, 17)) < rng.random()
        got = distance.envelope(height, known)
        for row in range(3):
            for p in range(17):
                want = min(((p - q) ** 2 + height[row, q], q) for q in range(17) if known[row, q])[1] if known[row].any() else -1
                assert got[row, p] == want


def test_empty(spark):
    assert distance.transformed(spark.createDataFrame([], "ix int, iz int, water boolean"), "water").count() == 0
