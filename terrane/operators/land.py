"""Surfaces that are edited along lines and seams, areas of connected cells, flow over a grid, and what lies around a place.

Cells have ix, iz and a value; lines are points or segments in the plane, which meet cells and points by grid cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import graphs
from terrane.operators import spatial as J
from terrane.operators import tiles as T
from terrane.operators.ranks import quantiles
from terrane.operators.raster import steepest_descent

_CROSS = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def box_mean_reflected(cells: DataFrame, v: str, reach: int, name: str) -> DataFrame:
    """Mean over the (2 reach + 1)^2 cells around, the grid mirrored at its edge cells (which aren't repeated). The grid is whole, and longer
    than ``reach`` in both directions."""
    return T.with_stencil(cells, [v], reach, lambda w: {name: T.weighed(T.beyond(w[v], "reflect"), [1 / (2 * reach + 1)] * (2 * reach + 1))}, [name])


def feathered(cells: DataFrame, block: DataFrame, v: str, reach: int) -> DataFrame:
    """Cells with the block's values where it has some. Outside, each cell moves by the step at the nearest cell beside the block (block's value
    less its own), less and less over ``reach`` cells; of equally near ones the first by ix, then iz counts."""
    own = block.select("ix", "iz", F.col(v).alias("_b"))
    outside = cells.join(own, ["ix", "iz"], "left_anti")
    there = own.withColumnsRenamed({"ix": "_jx", "iz": "_jz"})
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz"), F.lit(k).alias("k")) for k, (dx, dz) in enumerate(_CROSS)])
    beside = there.withColumn("_o", F.explode(moves)).select((F.col("_jx") + F.col("_o.dx")).alias("ix"), (F.col("_jz") + F.col("_o.dz")).alias("iz"), "_b", F.col("_o.k").alias("_k"))
    ring = outside.join(beside, ["ix", "iz"]).groupBy("ix", "iz").agg(F.min_by(F.col("_b") - F.col(v), "_k").alias("_step"))
    far = outside.select(F.struct("ix", "iz").alias("cell"), F.col("ix").cast("double").alias("x"), F.col("iz").cast("double").alias("z"))
    steps = ring.select(F.struct(F.col("ix").alias("a"), F.col("iz").alias("b")).alias("edge"), F.col("ix").cast("double").alias("x"), F.col("iz").cast("double").alias("z"), "_step")
    near = J.nearest_within(far, "cell", steps, "edge", float(reach), 1).select("cell.ix", "cell.iz", (F.col("_step") * (1 - F.col("d") / reach)).alias("_move"))
    moved = outside.join(near, ["ix", "iz"], "left").withColumn(v, F.col(v) + F.coalesce("_move", F.lit(0.0))).drop("_move")
    inside = cells.join(own, ["ix", "iz"]).withColumn(v, F.col("_b")).drop("_b")
    return moved.unionByName(inside)


def seam(cells: DataFrame, block: DataFrame, v: str) -> DataFrame:
    """mean, p95 and max of the steps between the block's cells and the cells beside them."""
    beside = block.select("ix", "iz", F.col(v).alias("_b")).withColumn("_o", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dx, dz in _CROSS])))
    beside = beside.select((F.col("ix") + F.col("_o.dx")).alias("ix"), (F.col("iz") + F.col("_o.dz")).alias("iz"), "_b").join(block.select("ix", "iz"), ["ix", "iz"], "left_anti")
    steps = cells.join(beside, ["ix", "iz"]).select(F.abs(F.col(v) - F.col("_b")).alias("step"))
    return steps.agg(F.avg("step").alias("mean"), F.max("step").alias("max")).crossJoin(quantiles(steps, [], "step", {"p95": 0.95})).select("mean", "p95", "max")  # a row of each


def snapped(points: DataFrame, cells: DataFrame, v: str, reach: int, cell: float, penalty: float = 0.04, smooth: int = 4) -> DataFrame:
    """Points of lines (line, k, x, z) moved across the line, by at most ``reach``, to where the ground (the nearest cell) is lowest; each unit costs
    ``penalty`` of height, of equally low places the first from the left end counts. Moves are means over ``smooth`` points to either side,
    with the end values repeated. Lines of fewer than three points stay; places off the grid count as high."""
    w = Window.partitionBy("line").orderBy("k")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    half = lambda c: F.when(F.lag(c).over(w).isNull(), F.lead(c).over(w) - F.col(c)).when(F.lead(c).over(w).isNull(), F.col(c) - F.lag(c).over(w)).otherwise((F.lead(c).over(w) - F.lag(c).over(w)) / 2)
    lined = points.withColumns({"_tx": half("x"), "_tz": half("z"), "_n": F.count("*").over(whole)})
    long = F.greatest(F.sqrt(F.col("_tx") * F.col("_tx") + F.col("_tz") * F.col("_tz")), F.lit(1e-9))
    lined = lined.withColumns({"_nx": -F.col("_tz") / long, "_nz": F.col("_tx") / long})
    tried = lined.withColumn("_o", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    at = lambda c, n: F.floor((F.col(c) + F.col(n) * F.col("_o")) / cell + 0.5).cast("int")
    ground = cells.select(F.col("ix").alias("_ix"), F.col("iz").alias("_iz"), F.col(v).alias("_v"))
    met = tried.withColumns({"_ix": at("x", "_nx"), "_iz": at("z", "_nz")}).join(ground, ["_ix", "_iz"], "left")
    cost = F.coalesce("_v", F.lit(float("inf"))) + F.abs("_o") * penalty
    best = met.groupBy("line", "k").agg(F.min_by("_o", F.struct(cost, F.col("_o"))).alias("_best"))
    found = lined.join(best, ["line", "k"])
    first, last = F.first("_best").over(whole), F.last("_best").over(whole)
    near = [F.coalesce(F.lag("_best", i).over(w), first) for i in range(smooth, 0, -1)] + [F.col("_best")] + [F.coalesce(F.lead("_best", i).over(w), last) for i in range(1, smooth + 1)]
    move = F.when(F.col("_n") >= 3, reduce(Column.__add__, near) / (2 * smooth + 1)).otherwise(0.0)
    return found.withColumn("_move", move).select("line", "k", (F.col("x") + F.coalesce(F.col("_nx") * F.col("_move"), F.lit(0.0))).alias("x"), (F.col("z") + F.coalesce(F.col("_nz") * F.col("_move"), F.lit(0.0))).alias("z"))


def carved(cells: DataFrame, v: str, beds: DataFrame, flat: float, bank: float, reach: float, protected: DataFrame | None = None, cell: float = 1.0) -> DataFrame:
    """Cells cut down to a stream's bed: within ``reach`` of the axis (segments seg, x1 z1 x2 z2, bed heights b1 b2) to the nearest segment's bed there, which
    is ``flat`` wide to either side and then rises by ``bank``; cells aren't raised, and ``protected`` ones stay."""
    keyed = cells.select("ix", "iz", (F.col("ix") * cell).alias("x"), (F.col("iz") * cell).alias("z"))
    keyed = keyed.withColumns({"_cx": J._cell("x", reach), "_cz": J._cell("z", reach)})
    met = keyed.join(J._segment_cells(beds, reach, reach), ["_cx", "_cz"])
    c = [F.col(n) for n in ("x", "z", "x1", "z1", "x2", "z2")]
    met = met.withColumns({"_d": G.segment_distance(*c), "_t": G.along_segment(*c)}).where(F.col("_d") <= reach)
    target = F.col("b1") + (F.col("b2") - F.col("b1")) * F.col("_t") + F.greatest(F.col("_d") - flat, F.lit(0.0)) * bank
    cut = met.groupBy("ix", "iz").agg(F.min_by(target, F.struct("_d", "seg")).alias("_target"))
    if protected is not None:
        cut = cut.join(protected.select("ix", "iz"), ["ix", "iz"], "left_anti")
    return cells.join(cut, ["ix", "iz"], "left").withColumn(v, F.least(v, "_target")).drop("_target")


def _numbered(ix: str, iz: str) -> Column:
    """A cell as one long."""
    return F.col(ix).cast("long") * (1 << 32) + F.col(iz).cast("long")


def areas(mask: DataFrame) -> DataFrame:
    """area, n and bounds of each group of cells that touch along sides; it is named by its least cell."""
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dx, dz in ((1, 0), (0, 1))])
    asked = mask.select("ix", "iz", F.explode(moves).alias("_o")).select("ix", "iz", (F.col("ix") + F.col("_o.dx")).alias("_jx"), (F.col("iz") + F.col("_o.dz")).alias("_jz"))
    met = asked.join(mask.select(F.col("ix").alias("_jx"), F.col("iz").alias("_jz")), ["_jx", "_jz"])
    edges = met.select(_numbered("ix", "iz").alias("src"), _numbered("_jx", "_jz").alias("dst"))
    labels = graphs.component_labels(edges)
    own = mask.select("ix", "iz", _numbered("ix", "iz").alias("id")).join(labels, "id", "left").withColumn("area", F.coalesce("component", "id"))
    return own.groupBy("area").agg(F.count("*").alias("n"), F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iz").alias("z0"), F.max("iz").alias("z1"))


def flow_totals(cells: DataFrame, v: str, weight: float = 1.0) -> DataFrame:
    """ix, iz and total: the weights of a cell and of all cells that drain through it by steepest descent."""
    down = steepest_descent(cells, v)
    pointers = down.select(_numbered("ix", "iz").alias("id"), F.when(F.col("tx").isNotNull(), _numbered("tx", "tz")).alias("next"), F.lit(float(weight)).alias("w"))
    totals = graphs.accumulated(pointers, "w")
    return cells.select("ix", "iz", _numbered("ix", "iz").alias("id")).join(totals, "id").select("ix", "iz", "total")


def shares_near(places: DataFrame, key: str, things: DataFrame, kind: str, radius: float) -> DataFrame:
    """key, kind and the share of each kind among the things around each place; nothing where there is none."""
    counts = J.within_radius(places.select(key, "x", "z"), things.select(kind, "x", "z"), radius).groupBy(key, kind).agg(F.count("*").alias("_n"))
    return counts.withColumn("share", F.col("_n") / F.sum("_n").over(Window.partitionBy(key))).drop("_n")


def witnessed(events: DataFrame, event: str, at: str, homes: DataFrame, home: str, radius: float, most: int = 40) -> DataFrame:
    """home, event and age (0: the newest) of what each home has witnessed within the radius; it remembers the newest ``most``."""
    seen = J.within_radius(homes.select(home, "x", "z"), events.select(event, at, "x", "z"), radius)
    order = Window.partitionBy(home).orderBy(F.desc(at), F.desc(event))
    return seen.withColumn("age", F.row_number().over(order) - 1).where(F.col("age") < most).select(home, event, "age")
