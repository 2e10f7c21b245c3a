"""The exact distance of every cell of a grid to the nearest cell of a set, and which cell that is.

First along columns: each cell's nearest set cell of its own column, by two sweeps of a window. Then along rows: the squared distance to the
set is the lower envelope of parabolas, one for each column, over the row's cells; whole numbers throughout. A task takes ``BLOCK``
rows and sweeps them together, cell by cell. Of equally near cells the first by ix, then iz, counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16


def transformed(cells: DataFrame, among: str) -> DataFrame:
    """ix, iz, nx, nz (the nearest cell where the column ``among`` is true) and square (its squared distance), null where there is none.
    ``cells`` (ix, iz and the column) are a whole grid, each cell once."""
    along = Window.partitionBy("ix").orderBy("iz")
    own = F.when(F.col(among), F.col("iz"))
    before = F.last(own, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(own, ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))
    swept = cells.select("ix", "iz", before.alias("_a"), after.alias("_b"))
    near = F.when(F.col("_b").isNull() | (F.col("iz") - F.col("_a") <= F.col("_b") - F.col("iz")), F.col("_a")).otherwise(F.col("_b"))
    columns = swept.select(F.col("ix").cast("long").alias("ix"), F.col("iz").cast("long").alias("iz"), near.cast("long").alias("nz"))
    return columns.groupBy(F.floor(F.col("iz") / BLOCK)).applyInArrow(_rows, "ix int, iz int, nx int, nz int, square long")


def _rows(block: pa.Table) -> pa.Table:
    """Rows of the grid with their nearest cells."""
    x, z = block["ix"].to_numpy(), block["iz"].to_numpy()
    there = block["nz"].is_valid().to_numpy()
    x0, z0 = x.min(), z.min()
    shape = int(z.max() - z0) + 1, int(x.max() - x0) + 1
    near = np.zeros(shape, np.int64)
    near[z[there] - z0, x[there] - x0] = block["nz"].to_numpy(zero_copy_only=False)[there]
    known = np.zeros(shape, bool)
    known[z[there] - z0, x[there] - x0] = True
    height = (near - (np.arange(shape[0]) + z0)[:, None]) ** 2
    at = envelope(height, known)[z - z0, x - x0]
    found = at >= 0
    row, best = z - z0, np.where(found, at, 0)
    square = (x - x0 - best) ** 2 + height[row, best]
    nothing = ~found
    return pa.table({
        "ix": pa.array(x, pa.int32()), "iz": pa.array(z, pa.int32()),
        "nx": pa.array(best + x0, pa.int32(), mask=nothing), "nz": pa.array(near[row, best], pa.int32(), mask=nothing), "square": pa.array(square, pa.int64(), mask=nothing),
    })


def envelope(height: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each row and place p the place q with the least (p - q)^2 + height[q], the first of equal ones; -1 in rows where none is known.

    Each row keeps a stack of the parabolas that are lowest somewhere, with the first place at which each is.
    """
    rows, width = height.shape
    lines = np.arange(rows)
    stack, start = np.full((rows, width + 1), -1), np.zeros((rows, width + 1), np.int64)
    size = np.zeros(rows, int)
    for q in range(width):
        begin = np.zeros(rows, np.int64)
        open_ = known[:, q].copy()
        adding = open_.copy()
        while open_.any():
            r = lines[open_ & (size > 0)]
            open_[:] = False
            if not len(r):
                break
            top = stack[r, size[r] - 1]
            # The first place at which q is strictly lower than the top.
            first = (height[r, q] + q * q - height[r, top] - top * top) // (2 * (q - top)) + 1
            begin[r] = first
            lower = first <= start[r, size[r] - 1]
            size[r[lower]] -= 1
            open_[r[lower]] = True
        begin[size == 0] = 0
        adding &= begin < width
        r = lines[adding]
        stack[r, size[r]], start[r, size[r]] = q, np.maximum(begin[r], 0)
        size[r] += 1
    out = np.full((rows, width), -1)
    current = np.zeros(rows, int)
    some = size > 0
    for p in range(width):
        while True:
            step = some & (current + 1 < size) & (start[lines, np.minimum(current + 1, width)] <= p)
            if not step.any():
                break
            current[step] += 1
        out[some, p] = stack[some, current[some]]
    return out
