"""Raster algebra on cell tables: a row a cell, keyed by ix and iz, with a value column.

Neighbourhoods are stencils on tiles (``tiles``): one shuffle brings a tile and what lies around it to a task, whatever the chain of steps. Nulls
don't count in them. The rest are equi-joins and groups of cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import tiles as T

_CROSS = [(1, 0), (-1, 0), (0, 1), (0, -1)]
_D8 = [(dx, dz) for dz in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dz]


def box_sum(cells: DataFrame, v: str, reach: int, name: str) -> DataFrame:
    """Sum over the (2 reach + 1)^2 cells around; cells beyond the edge count 0."""
    return T.with_stencil(cells, [v], reach, lambda w: {name: T.weighed(w[v], [1.0] * (2 * reach + 1))}, [name])


def _box_mean(layer: np.ndarray, reach: int) -> np.ndarray:
    ones = [1.0] * (2 * reach + 1)
    return T.weighed(layer, ones) / np.maximum(T.weighed(np.where(np.isnan(layer), 0.0, 1.0), ones), 1.0)


def box_mean(cells: DataFrame, v: str, reach: int, name: str) -> DataFrame:
    """Mean over the part of the box that lies on the grid."""
    return T.with_stencil(cells, [v], reach, lambda w: {name: _box_mean(w[v], reach)}, [name])


def box_mean_clamped(cells: DataFrame, v: str, reach: int, name: str) -> DataFrame:
    """Mean over the box with the edge cells repeated beyond the edge. The grid is whole."""
    return T.with_stencil(cells, [v], reach, lambda w: {name: T.weighed(T.beyond(w[v], "edge"), [1 / (2 * reach + 1)] * (2 * reach + 1))}, [name])


def gaussian(cells: DataFrame, v: str, sigma: float, reach: int, name: str) -> DataFrame:
    """Gaussian smoothing, along rows and then columns; beyond the edge nothing counts, and the weights there add up to less."""
    return T.with_stencil(cells, [v], reach, lambda w: {name: T.gaussian(w[v], sigma, reach)}, [name])


def relative_height(cells: DataFrame, v: str, reach: int, name: str = "tpi") -> DataFrame:
    """The cell less the mean of its neighbourhood."""
    return T.with_stencil(cells, [v], reach, lambda w: {name: w[v] - _box_mean(w[v], reach)}, [name])


def gradient(cells: DataFrame, v: str, cell: float = 1.0) -> DataFrame:
    """gx and gz by central differences, one-sided at the edges, slope in degrees and aspect (downhill, from +z clockwise)."""

    def slopes(w: T.Window) -> dict[str, np.ndarray]:
        def along(dz: int, dx: int) -> np.ndarray:
            before, after, x = T.moved(w[v], -dz, -dx), T.moved(w[v], dz, dx), w[v]
            return np.where(np.isnan(before), after - x, np.where(np.isnan(after), x - before, (after - before) / 2)) / cell

        gx, gz = along(0, 1), along(1, 0)
        return {"gx": gx, "gz": gz, "slope": np.degrees(np.arctan(np.sqrt(gx * gx + gz * gz))), "aspect": np.degrees(np.arctan2(-gx, -gz)) % 360.0}

    return T.with_stencil(cells, [v], 1, slopes, ["gx", "gz", "slope", "aspect"])


def laplacian(cells: DataFrame, v: str, name: str = "lap") -> DataFrame:
    """Sum of the four neighbours less four times the cell; null at the edges."""
    return T.with_stencil(cells, [v], 1, lambda w: {name: sum(T.moved(w[v], dz, dx) for dx, dz in _CROSS) - 4 * w[v]}, [name])


def local_maxima(cells: DataFrame, v: str, reach: int = 1) -> DataFrame:
    """Cells as high as the highest of their neighbourhood."""
    return T.with_stencil(cells, [v], reach, lambda w: {"_m": T.highest(w[v], reach)}, ["_m"]).where(F.col(v) >= F.col("_m")).drop("_m")


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets of a disc: dx^2 + dz^2 <= radius^2 + 1."""
    return [(dx, dz) for dx in range(-radius, radius + 1) for dz in range(-radius, radius + 1) if dx * dx + dz * dz <= radius * radius + 1]


def dilated(mask: DataFrame, radius: int, domain: DataFrame) -> DataFrame:
    """The mask grown by a disc, within the domain."""
    return _morphed(mask, domain, radius, lambda m, d: T.grown(m, disc(radius)) & d)


def eroded(mask: DataFrame, radius: int, domain: DataFrame) -> DataFrame:
    """Cells of the mask whose disc lies in the mask, as far as it lies in the domain: the dual of growing the rest."""
    return _morphed(mask, domain, radius, lambda m, d: m & ~T.grown(d & ~m, disc(radius)))


def opened(mask: DataFrame, radius: int, domain: DataFrame) -> DataFrame:
    """Eroded, then dilated, in one go."""
    return _morphed(mask, domain, 2 * radius, lambda m, d: T.grown(m & ~T.grown(d & ~m, disc(radius)), disc(radius)) & d)


def _morphed(mask: DataFrame, domain: DataFrame, reach: int, change) -> DataFrame:
    return T.where_stencil({"mask": mask, "domain": domain}, reach, lambda w: change(w["mask"] == 1, w["domain"] == 1))


def block_mean(cells: DataFrame, v: str, factor: int, nx: int, nz: int, name: str = "mean") -> DataFrame:
    """Means of factor by factor blocks; cells of incomplete blocks at the far edges don't count."""
    whole = cells.where((F.col("ix") < nx // factor * factor) & (F.col("iz") < nz // factor * factor))
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return whole.groupBy(block("ix"), block("iz")).agg(F.avg(v).alias(name))


def overlaid(layers: list[DataFrame], value: str) -> DataFrame:
    """One value a cell: that of the last layer which covers it."""
    painted = [layer.select("ix", "iz", F.lit(k).alias("_p"), value) for k, layer in enumerate(layers)]
    union = painted[0]
    for layer in painted[1:]:
        union = union.unionByName(layer)
    return union.groupBy("ix", "iz").agg(F.max_by(value, F.struct("_p", value)).alias(value))


def zonal(cells: DataFrame, zones: DataFrame, zone: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates of the cells of each zone; a cell may be in several."""
    return zones.select(zone, "ix", "iz").join(cells, ["ix", "iz"]).groupBy(zone).agg(*aggregates)


def covered_share(footprints: DataFrame, key: str, mask: DataFrame, name: str) -> DataFrame:
    """The share of each footprint's cells that lie in the mask."""
    marked = footprints.join(mask.select("ix", "iz").distinct().withColumn("_in", F.lit(1.0)), ["ix", "iz"], "left")
    return marked.groupBy(key).agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias(name))


def gathered(points: DataFrame, cells: DataFrame, x: str, z: str, v: str, name: str, x0: float = 0.0, z0: float = 0.0, cell: float = 1.0) -> DataFrame:
    """Value at each point's nearest cell centre; null off the grid."""
    near = points.withColumns({"_ix": F.floor((F.col(x) - x0) / cell + 0.5).cast("int"), "_iz": F.floor((F.col(z) - z0) / cell + 0.5).cast("int")})
    source = cells.select(F.col("ix").alias("_ix"), F.col("iz").alias("_iz"), F.col(v).alias(name))
    return near.join(source, ["_ix", "_iz"], "left").drop("_ix", "_iz")


def bilinear(points: DataFrame, key: str, cells: DataFrame, x: str, z: str, v: str, name: str, x0: float = 0.0, z0: float = 0.0, cell: float = 1.0) -> DataFrame:
    """key and the value interpolated between the four cells around each point; points off the grid are left out."""
    gx, gz = (F.col(x) - x0) / cell, (F.col(z) - z0) / cell
    at = points.select(key, gx.alias("gx"), gz.alias("gz"), F.floor(gx).cast("int").alias("bx"), F.floor(gz).cast("int").alias("bz"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    asked = at.withColumn("_c", F.explode(corners)).withColumns({"ix": F.col("bx") + F.col("_c.i"), "iz": F.col("bz") + F.col("_c.j")})
    share = lambda g, b, k: F.when(F.col(f"_c.{k}") == 1, F.col(g) - F.col(b)).otherwise(1 - (F.col(g) - F.col(b)))
    weighted = asked.withColumn("_w", share("gx", "bx", "i") * share("gz", "bz", "j")).join(cells.select("ix", "iz", v), ["ix", "iz"])
    return weighted.groupBy(key).agg(F.sum(F.col("_w") * F.col(v)).alias(name), F.count("*").alias("_n")).where("_n = 4").drop("_n")


def steepest_descent(cells: DataFrame, v: str) -> DataFrame:
    """ix, iz and the neighbour (tx, tz) with the greatest drop a distance; null in pits. Of equal drops the first neighbour by row, then column, wins."""
    moves = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for k, (dx, dz) in enumerate(_D8)])
    asked = cells.select("ix", "iz", F.col(v).alias("_v"), F.explode(moves).alias("_m")).withColumns({"tx": F.col("ix") + F.col("_m.dx"), "tz": F.col("iz") + F.col("_m.dz")})
    there = cells.select(F.col("ix").alias("tx"), F.col("iz").alias("tz"), F.col(v).alias("_t"))
    far = F.sqrt((F.col("_m.dx") * F.col("_m.dx") + F.col("_m.dz") * F.col("_m.dz")).cast("double"))
    drops = asked.join(there, ["tx", "tz"]).withColumn("_d", (F.col("_v") - F.col("_t")) / far).where("_d > 0")
    best = drops.groupBy("ix", "iz").agg(F.min_by(F.struct("tx", "tz"), F.struct(-F.col("_d"), F.col("_m.k"))).alias("_b"))
    return cells.select("ix", "iz").join(best, ["ix", "iz"], "left").select("ix", "iz", F.col("_b.tx").alias("tx"), F.col("_b.tz").alias("tz"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def _mirrored(layer: np.ndarray, weights: list[float]) -> np.ndarray:
    """Weighted sums along rows and columns; beyond the edges the grid is mirrored, its edge cells repeated."""
    return T.weighed(T.beyond(layer, "symmetric"), weights)


def similarity(cells: DataFrame, a: str, b: str, sigma: float = 1.5) -> DataFrame:
    """ix, iz and s: the structural similarity of two columns of 0..1 at each cell, over a Gaussian neighbourhood; its mean is that of the images.
    The grid is whole."""
    # The constants that keep quotients steady.
    c1, c2 = 0.01**2, 0.03**2
    weights = gaussian_weights(sigma)

    def compare(w: T.Window) -> dict[str, np.ndarray]:
        x, y = w[a], w[b]
        ma, mb, aa, bb, ab = (_mirrored(layer, weights) for layer in (x, y, x * x, y * y, x * y))
        va, vb, cab = aa - ma * ma, bb - mb * mb, ab - ma * mb
        return {"s": ((2 * ma * mb + c1) * (2 * cab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))}

    return T.with_stencil(cells.select("ix", "iz", a, b), [a, b], len(weights) // 2, compare, ["s"]).select("ix", "iz", "s")


def flat_cells(cells: DataFrame, columns: list[str], most: float = 1e-7) -> DataFrame:
    """ix and iz of the cells whose columns hardly vary over the three by three cells around. The grid is whole."""

    def spread(w: T.Window) -> dict[str, np.ndarray]:
        thirds = [1 / 3] * 3
        return {"_spread": sum(np.maximum(_mirrored(w[c] * w[c], thirds) - _mirrored(w[c], thirds) ** 2, 0.0) for c in columns)}

    return T.with_stencil(cells.select("ix", "iz", *columns), columns, 1, spread, ["_spread"]).where(F.col("_spread") < most).select("ix", "iz")


# Waves a cell from which they are high, and near the finest.
HIGH_WAVES, FINEST_WAVES = 0.25, 0.42


def fine_shares(cells: DataFrame, image: str, v: str, radius: float = HIGH_WAVES, edge: float = FINEST_WAVES) -> DataFrame:
    """image and the shares of its spectrum's energy beyond a radius (high) and near the finest waves of either axis (edge), in waves a cell; the mean
    is taken off and a Hann window laid over. An image is held by one task: its size is that of a screen."""

    def shares(group: pd.DataFrame) -> pd.DataFrame:
        size = group["iz"].max() + 1, group["ix"].max() + 1
        picture = np.zeros(size)
        picture[group["iz"], group["ix"]] = group[v]
        window = np.outer(np.hanning(size[0]), np.hanning(size[1]))
        power = np.abs(np.fft.fft2((picture - picture.mean()) * window)) ** 2
        fz, fx = np.abs(np.fft.fftfreq(size[0]))[:, None], np.abs(np.fft.fftfreq(size[1]))[None, :]
        total = power.sum() - power[0, 0]
        parts = [power[np.hypot(fx, fz) > radius].sum(), power[(fx > edge) | (fz > edge)].sum()]
        high, fine = (p / total if total > 1e-12 else 0.0 for p in parts)
        return pd.DataFrame({image: [group[image].iloc[0]], "high": [high], "edge": [fine]})

    kind = dict(cells.dtypes)[image]
    return cells.select(image, "ix", "iz", v).groupBy(image).applyInPandas(shares, f"{image} {kind}, high double, edge double")
