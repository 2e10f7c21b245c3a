"""Tiles: square pieces of a raster as arrays, which get what lies around them in one shuffle and run any chain of stencils in numpy.

Cells (a row a cell: ix, iz and values) go to their own tile and to the tiles that they are less than ``reach`` cells away from; packed tiles (a row
a tile: tx, tz and a binary of doubles for each layer) send strips of their borders. Either way a task then holds the window of one
tile, its cells and a halo of ``reach`` cells around, and a stencil is a function of windows. A chain's reach is the sum of its steps'. A tile holds
``size`` by ``size`` cells, whatever the raster's extent.

A cell that isn't there, or has a null value, is NaN in a window. What stands beyond the raster's edge is up to the stencil: nothing,
or the raster itself, mirrored or with its edge repeated (``beyond``; the raster is whole then).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 256


@dataclass
class Window:
    """The layers of one tile and its halo, [z, x]; x0 and z0 are the cell of their first element."""

    layers: dict[str, np.ndarray]
    x0: int
    z0: int
    reach: int

    def __getitem__(self, name: str) -> np.ndarray:
        return self.layers[name]

    def core(self, layer: np.ndarray) -> np.ndarray:
        r = self.reach
        return layer[r : layer.shape[0] - r, r : layer.shape[1] - r]


#: Layers by name, each as large as the window; what they hold in the halo doesn't matter.
Stencil = Callable[[Window], dict[str, np.ndarray]]


def _spread(cells: DataFrame, reach: int, size: int) -> DataFrame:
    """Each cell once for every tile whose window it lies in."""
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / size).cast("int"), F.floor((F.col(c) + reach) / size).cast("int")))
    return cells.withColumn("_tx", tiles("ix")).withColumn("_tz", tiles("iz"))


def _window(rows: pa.Table, layers: list[str], reach: int, size: int) -> tuple[Window, np.ndarray, np.ndarray]:
    x0, z0 = rows["_tx"][0].as_py() * size - reach, rows["_tz"][0].as_py() * size - reach
    x, z = rows["ix"].to_numpy().astype(np.int64) - x0, rows["iz"].to_numpy().astype(np.int64) - z0
    side = size + 2 * reach
    made = {}
    for name in layers:
        column = pc.cast(rows[name], pa.float64())
        there = pc.is_valid(column).to_numpy()
        made[name] = np.full((side, side), np.nan)
        made[name][z[there], x[there]] = pc.drop_null(column).to_numpy()
    return Window(made, x0, z0, reach), x, z


def with_stencil(cells: DataFrame, layers: list[str], reach: int, stencil: Stencil, names: list[str], size: int = SIZE) -> DataFrame:
    """The cells with all their columns, and doubles that the stencil makes of ``layers``; NaN becomes null."""
    fields = [f for f in cells.schema.fields if f.name not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{n}` double" for n in names)])

    def run(rows: pa.Table) -> pa.Table:
        window, x, z = _window(rows, layers, reach, size)
        made = stencil(window)
        own = (x >= reach) & (x < size + reach) & (z >= reach) & (z < size + reach)
        kept = rows.select([f.name for f in fields]).filter(pa.array(own))
        for name in names:
            kept = kept.append_column(name, pa.array(made[name][z[own], x[own]].astype(float), pa.float64(), from_pandas=True))
        return kept

    return _spread(cells, reach, size).groupBy("_tx", "_tz").applyInArrow(run, schema)


def where_stencil(layers: dict[str, DataFrame], reach: int, stencil: Callable[[Window], np.ndarray], size: int = SIZE) -> DataFrame:
    """ix and iz of the cells for which the stencil is true; each layer is a set of cells, 1 where it has one."""
    names, rows = list(layers), None
    for name, cells in layers.items():
        own = cells.select("ix", "iz", *[(F.lit(1.0) if other == name else F.lit(None).cast("double")).alias(other) for other in names])
        rows = own if rows is None else rows.unionByName(own)

    def run(table: pa.Table) -> pa.Table:
        window, _, _ = _window(table, names, reach, size)
        z, x = np.nonzero(window.core(stencil(window)))
        return pa.table({"ix": pa.array(x + window.x0 + reach, pa.int32()), "iz": pa.array(z + window.z0 + reach, pa.int32())})

    return _spread(rows, reach, size).groupBy("_tx", "_tz").applyInArrow(run, "ix int, iz int")


def packed(cells: DataFrame, layers: list[str], size: int = SIZE) -> DataFrame:
    """Cells as tiles: tx, tz and for each layer size * size doubles by rows, NaN where no cell has a value."""

    def pack(rows: pa.Table) -> pa.Table:
        window, _, _ = _window(rows, layers, 0, size)
        return pa.table({"tx": rows["_tx"].slice(0, 1), "tz": rows["_tz"].slice(0, 1), **{n: pa.array([window[n].tobytes()], pa.binary()) for n in layers}})

    return _spread(cells.select("ix", "iz", *layers), 0, size).groupBy("_tx", "_tz").applyInArrow(pack, "tx int, tz int, " + ", ".join(f"{n} binary" for n in layers))


def unpacked(tiles: DataFrame, layers: list[str], size: int = SIZE) -> DataFrame:
    """Tiles as cells: those where some layer has a value."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = {n: np.frombuffer(row[n]).reshape(size, size) for n in layers}
                z, x = np.nonzero(~np.all([np.isnan(v) for v in values.values()], axis=0))
                at = [pa.array(x + row["tx"] * size, pa.int32()), pa.array(z + row["tz"] * size, pa.int32())]
                yield pa.RecordBatch.from_arrays(at + [pa.array(v[z, x], pa.float64(), from_pandas=True) for v in values.values()], ["ix", "iz", *layers])

    return tiles.select("tx", "tz", *layers).mapInArrow(unpack, "ix int, iz int, " + ", ".join(f"{n} double" for n in layers))


def over_tiles(tiles: DataFrame, layers: list[str], reach: int, stencil: Stencil, names: list[str], size: int = SIZE) -> DataFrame:
    """Packed tiles of what the stencil makes of packed tiles. A tile sends each of the tiles around the strip that its window needs."""
    strip = "tx int, tz int, x int, z int, w int, h int, " + ", ".join(f"{n} binary" for n in layers)
    far = -(-reach // size)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = {n: np.frombuffer(row[n]).reshape(size, size) for n in layers}
                out = []
                for dx in range(-far, far + 1):
                    for dz in range(-far, far + 1):
                        # The part of this tile that lies in the window of the tile dx, dz away, in cells of this tile.
                        x, z = (slice(max(0, d * size - reach), min(size, (d + 1) * size + reach)) for d in (dx, dz))
                        if x.stop > x.start and z.stop > z.start:
                            place = {"x": x.start - dx * size + reach, "z": z.start - dz * size + reach, "w": x.stop - x.start, "h": z.stop - z.start}
                            out.append({"tx": row["tx"] + dx, "tz": row["tz"] + dz, **place, **{n: np.ascontiguousarray(v[z, x]).tobytes() for n, v in values.items()}})
                schema = pa.schema([*((c, pa.int32()) for c in ("tx", "tz", "x", "z", "w", "h")), *((n, pa.binary()) for n in layers)])
                yield pa.RecordBatch.from_pylist(out, schema)

    def run(rows: pa.Table) -> pa.Table:
        side = size + 2 * reach
        made = {n: np.full((side, side), np.nan) for n in layers}
        own = False
        for row in rows.to_pylist():
            own = own or row["x"] == row["z"] == reach
            for n in layers:
                made[n][row["z"] : row["z"] + row["h"], row["x"] : row["x"] + row["w"]] = np.frombuffer(row[n]).reshape(row["h"], row["w"])
        tx, tz = rows["tx"][0].as_py(), rows["tz"][0].as_py()
        window = Window(made, tx * size - reach, tz * size - reach, reach)
        found = stencil(window) if own else {}  # no tile where there was none
        made_tiles = [{"tx": tx, "tz": tz, **{n: np.ascontiguousarray(window.core(found[n]), dtype=float).tobytes() for n in names}}] if own else []
        return pa.Table.from_pylist(made_tiles, pa.schema([("tx", pa.int32()), ("tz", pa.int32()), *((n, pa.binary()) for n in names)]))

    return tiles.select("tx", "tz", *layers).mapInArrow(send, strip).groupBy("tx", "tz").applyInArrow(run, "tx int, tz int, " + ", ".join(f"{n} binary" for n in names))


def moved(layer: np.ndarray, dz: int, dx: int, fill: float = np.nan) -> np.ndarray:
    """At each cell the value of the cell dz, dx away."""
    out = np.full_like(layer, fill)
    h, w = layer.shape
    to_z, to_x = slice(max(0, -dz), min(h, h - dz)), slice(max(0, -dx), min(w, w - dx))
    from_z, from_x = slice(max(0, dz), min(h, h + dz)), slice(max(0, dx), min(w, w + dx))
    if to_z.start < to_z.stop and to_x.start < to_x.stop:
        out[to_z, to_x] = layer[from_z, from_x]
    return out


def weighed(layer: np.ndarray, weights: list[float]) -> np.ndarray:
    """Weighted sums along x, then along z; beyond the window, and where it has no value, nothing counts."""
    reach = len(weights) // 2
    out = np.nan_to_num(layer)
    out = sum(w * moved(out, 0, k - reach, 0.0) for k, w in enumerate(weights))
    return sum(w * moved(out, k - reach, 0, 0.0) for k, w in enumerate(weights))


def beyond(layer: np.ndarray, mode: str) -> np.ndarray:
    """The window with the raster carried on beyond its edges: ``edge`` repeats edge cells, ``reflect`` mirrors at them, ``symmetric`` behind them."""
    there = ~np.isnan(layer)
    z, x = np.flatnonzero(there.any(axis=1)), np.flatnonzero(there.any(axis=0))
    if not len(z):
        return layer
    inner = layer[z[0] : z[-1] + 1, x[0] : x[-1] + 1]
    return np.pad(inner, ((z[0], layer.shape[0] - 1 - z[-1]), (x[0], layer.shape[1] - 1 - x[-1])), mode)


def gaussian(layer: np.ndarray, sigma: float, reach: int) -> np.ndarray:
    """Gaussian smoothing along x, then z, of the cells that are there; the weights of others don't count."""
    weights = [float(np.exp(-(k * k) / (2 * sigma * sigma))) for k in range(-reach, reach + 1)]
    there = ~np.isnan(layer)
    for step in ((0, 1), (1, 0)):
        ways = [(w, step[0] * (k - reach), step[1] * (k - reach)) for k, w in enumerate(weights)]
        total = sum(w * moved(np.nan_to_num(layer), dz, dx, 0.0) for w, dz, dx in ways)
        weight = sum(w * moved(there.astype(float), dz, dx, 0.0) for w, dz, dx in ways)
        layer = np.where(there, total / np.where(weight > 0, weight, 1.0), np.nan)
    return layer


def grown(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """A set of cells (booleans) moved by every offset (dx, dz)."""
    out = np.zeros_like(mask)
    for dx, dz in offsets:
        out |= moved(mask, -dz, -dx, False)
    return out


def highest(layer: np.ndarray, reach: int) -> np.ndarray:
    """The greatest value of the (2 reach + 1)^2 cells around."""
    low = np.where(np.isnan(layer), -np.inf, layer)
    for step in ((0, 1), (1, 0)):
        low = np.max([moved(low, step[0] * k, step[1] * k, -np.inf) for k in range(-reach, reach + 1)], axis=0)
    return low
