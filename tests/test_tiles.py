"""Stencils on small tiles against the same arrays as a whole."""

import numpy as np
import pytest

from terrane.operators import raster, tiles

SIZE = 7


def grid_of(seed, w, h, holes=0.0):
    rng = np.random.default_rng(seed)
    layer = rng.normal(0, 10, (h, w)).round(3)
    layer[rng.random((h, w)) < holes] = np.nan
    return layer


def frame(spark, layer, x0=0, z0=0):
    z, x = np.nonzero(~np.isnan(layer))
    return spark.createDataFrame([(int(i) + x0, int(k) + z0, float(layer[k, i]), f"cell {i}") for k, i in zip(z, x)], "ix int, iz int, v double, name string").repartition(3)


def values(rows, name, shape, x0=0, z0=0):
    out = np.full(shape, np.nan)
    for r in rows.collect():
        assert r["name"] == f"cell {r['ix'] - x0}"
        out[r["iz"] - z0, r["ix"] - x0] = np.nan if r[name] is None else r[name]
    return out


@pytest.mark.parametrize("x0, z0, holes", [(0, 0, 0.0), (-5, 3, 0.2), (-100, -31, 0.6)])
def test_chain_over_tiles_equals_the_whole(spark, x0, z0, holes):
    layer = grid_of(1, 31, 24, holes)

    def chain(w):
        a = tiles.gaussian(w["v"], 1.2, 3)
        return {"a": a, "b": tiles.moved(a, 1, -1) + tiles.highest(w["v"], 2)}

    whole = chain({"v": np.pad(layer, 10, constant_values=np.nan)})
    cells = frame(spark, layer, x0, z0)
    got = tiles.with_stencil(cells, ["v"], 4, chain, ["a", "b"], SIZE)
    back = tiles.unpacked(tiles.over_tiles(tiles.packed(cells, ["v"], SIZE), ["v"], 4, chain, ["a", "b"], SIZE), ["a"], SIZE).collect()
    for name in ("a", "b"):
        want = np.where(np.isnan(layer), np.nan, whole[name][10:-10, 10:-10])
        np.testing.assert_allclose(values(got, name, layer.shape, x0, z0), want, atol=1e-12)
    packed = {(r["ix"] - x0, r["iz"] - z0): r["a"] for r in back}
    assert len(packed) == (~np.isnan(layer)).sum()
    assert all(abs(a - whole["a"][z + 10, x + 10]) < 1e-12 for (x, z), a in packed.items())


@pytest.mark.parametrize("mode", ["edge", "symmetric", "reflect"])
def test_beyond_the_edges(spark, mode):
    layer = grid_of(2, 29, 15)
    box = [1 / 5] * 5
    got = tiles.with_stencil(frame(spark, layer), ["v"], 2, lambda w: {"m": tiles.weighed(tiles.beyond(w["v"], mode), box)}, ["m"], SIZE)
    padded = np.pad(layer, 2, mode)
    want = [[padded[z : z + 5, x : x + 5].mean() for x in range(29)] for z in range(15)]
    np.testing.assert_allclose(values(got, "m", layer.shape), want, atol=1e-12)


@pytest.mark.parametrize("reach", [1, 3, 8, 15])
def test_halos_wider_than_a_tile(spark, reach):
    layer = grid_of(3, 40, 33, 0.3)
    cells = frame(spark, layer)
    total = lambda w: {"s": tiles.weighed(w["v"], [1.0] * (2 * reach + 1))}
    filled = np.pad(np.nan_to_num(layer), reach)
    want = np.array([[filled[z : z + 2 * reach + 1, x : x + 2 * reach + 1].sum() for x in range(40)] for z in range(33)])
    np.testing.assert_allclose(values(tiles.with_stencil(cells, ["v"], reach, total, ["s"], SIZE), "s", layer.shape), np.where(np.isnan(layer), np.nan, want), atol=1e-9)
    packed = tiles.unpacked(tiles.over_tiles(tiles.packed(cells, ["v"], SIZE), ["v"], reach, total, ["s"], SIZE), ["s"], SIZE).collect()
    for r in packed:
        if r["ix"] in range(40) and r["iz"] in range(33):
            assert abs(r["s"] - want[r["iz"], r["ix"]]) < 1e-9


def test_sets_of_cells(spark):
    rng = np.random.default_rng(4)
    domain, mask = rng.random((30, 30)) < 0.9, rng.random((30, 30)) < 0.75
    mask &= domain
    cells = lambda m: spark.createDataFrame([(int(x), int(z)) for z, x in zip(*np.nonzero(m))], "ix int, iz int")
    at = lambda m, x, z: 0 <= x < 30 and 0 <= z < 30 and bool(m[z, x])
    disc = raster.disc(1)
    eroded = np.array([[mask[z, x] and all(at(mask, x + dx, z + dz) or not at(domain, x + dx, z + dz) for dx, dz in disc) for x in range(30)] for z in range(30)])
    opened = {(x, z) for x in range(30) for z in range(30) if domain[z, x] and any(at(eroded, x + dx, z + dz) for dx, dz in disc)}
    grown = {(x, z) for x in range(30) for z in range(30) if domain[z, x] and any(at(mask, x + dx, z + dz) for dx, dz in disc)}
    got = lambda rows: {(r["ix"], r["iz"]) for r in rows.collect()}
    assert got(raster.eroded(cells(mask), 1, cells(domain))) == {(x, z) for z, x in zip(*np.nonzero(eroded))}
    assert got(raster.opened(cells(mask), 1, cells(domain))) == opened
    assert got(raster.dilated(cells(mask), 1, cells(domain))) == grown


def test_one_shuffle_whatever_the_chain(spark):
    cells = spark.range(10).selectExpr("CAST(id AS INT) AS ix", "CAST(id AS INT) AS iz", "CAST(id AS DOUBLE) AS v", "v AS w")
    for made in (raster.gaussian(cells, "v", 1.5, 4, "s"), raster.opened(cells, 2, cells), raster.similarity(cells, "v", "w"), raster.box_mean_clamped(cells, "v", 2, "m")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_empty_and_nulls(spark):
    cells = spark.createDataFrame([(0, 0, None), (1, 0, 2.0)], "ix int, iz int, v double")
    assert raster.box_sum(cells.limit(0), "v", 1, "s").count() == 0
    assert {(r["ix"], r["s"]) for r in raster.box_sum(cells, "v", 1, "s").collect()} == {(0, 2.0), (1, 2.0)}
    assert tiles.unpacked(tiles.packed(cells, ["v"], 4), ["v"], 4).collect() == [(1, 0, 2.0)]
