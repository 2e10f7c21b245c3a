"""Nearest neighbours by a quadtree whose cells are split by what they hold, without a radius to start from.

A cell with more than ``capacity`` points has four children, down to ``DEPTH`` levels; cells are named by their level and the interleaved
bits of their column and row. A place with many points counts as the few with the smallest keys, more of which no answer can need. So a leaf is
a bounded group, however crowded a spot is.

A row that asks finds the deepest cell around it that holds as many points as are wanted: its points (of a leaf), or its far corner, bound the
answer's distance. The circle of that radius lies in two by two cells of a level where cells are as wide as the circle. From these the search goes
down, a level a round for all rows at once, into children that reach into the circle, and ends at leaves, whose points are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.sources.tables import cut_counted, cut_lineage

DEPTH = 24
CAPACITY = 32
#: Levels that are counted in one pass.
STEP = 4


def _c(name: str) -> Column:
    return F.col(name)


def _interleaved(i: Column, j: Column) -> Column:
    """The bits of i and j in turn."""

    def apart(v: Column) -> Column:
        for shift in (16, 8, 4, 2, 1):
            mask = int(("0" * shift + "1" * shift) * (32 // shift), 2)
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return apart(i.cast("long")).bitwiseOR(F.shiftleft(apart(j.cast("long")), 1))


class Square:
    """The square in which the tree lies."""

    def __init__(self, x0: float, z0: float, side: float) -> None:
        self.x0, self.z0, self.side = x0, z0, side

    def index(self, v: Column, origin: float, level: Column) -> Column:
        """Column or row at a level, the nearest one for places outside."""
        cells = F.pow(F.lit(2.0), level)
        return F.greatest(F.least(F.floor((v - origin) / self.side * cells), cells - 1), F.lit(0.0)).cast("long")

    def coded(self, rows: DataFrame) -> DataFrame:
        """Rows with _i and _j, their column and row on the finest level, and _code."""
        at = rows.withColumns({"_i": self.index(_c("x"), self.x0, F.lit(DEPTH)), "_j": self.index(_c("z"), self.z0, F.lit(DEPTH))})
        return at.withColumn("_code", _interleaved(_c("_i"), _c("_j")))

    def corner(self, i: str, level: str, origin: float, end: int) -> Column:
        return self.side / F.pow(F.lit(2.0), _c(level)) * (_c(i) + end) + origin

    def reach(self, nearest: bool) -> Column:
        """Distance of x, z from the nearest, or the farthest, place of the cell _level, _ni, _nj."""
        x, z = ((self.corner("_ni", "_level", self.x0, end) - _c("x"), self.corner("_nj", "_level", self.z0, end) - _c("z")) for end in (0, 1))
        (x_low, z_low), (x_high, z_high) = x, z
        if nearest:
            dx, dz = F.greatest(x_low, -x_high, F.lit(0.0)), F.greatest(z_low, -z_high, F.lit(0.0))
        else:
            dx, dz = F.greatest(F.abs(x_low), F.abs(x_high)), F.greatest(F.abs(z_low), F.abs(z_high))
        return F.sqrt(dx * dx + dz * dz)


def _up(code: str, by: Column | int) -> Column:
    return F.expr(f"shiftright({code}, CAST(2 * ({by if isinstance(by, str) else int(by)}) AS INT))")


def nodes(points: DataFrame, capacity: int) -> DataFrame:
    """_level, _node, _ni, _nj and _n of the cells: all whose parents hold more than ``capacity`` points. ``points`` are coded, and written."""
    root = points.groupBy(F.lit(0).alias("_level"), F.lit(0).cast("long").alias("_node")).agg(F.count("*").alias("_n"))
    found, n = cut_counted(root.select("_level", "_node", F.lit(0).cast("long").alias("_ni"), F.lit(0).cast("long").alias("_nj"), "_n"), "root", _c("_n") > capacity)
    full = found.where(_c("_n") > capacity)
    for level in range(0, DEPTH, STEP):
        if not n:
            break
        inside = points.withColumn("_node", _up("_code", DEPTH - level)).join(full.select("_node"), "_node", "left_semi") if level else points
        deepest = min(level + STEP, DEPTH)
        counts = inside.groupBy(_up("_code", DEPTH - deepest).alias("_node")).agg(F.min(F.shiftright("_i", DEPTH - deepest)).alias("_ni"), F.min(F.shiftright("_j", DEPTH - deepest)).alias("_nj"), F.count("*").alias("_n"))
        layer = cut_lineage(counts.select(F.lit(deepest).alias("_level"), "_node", "_ni", "_nj", "_n"), "counts")
        made = layer
        for up in range(deepest - 1, level, -1):
            layer = layer.groupBy(F.shiftright("_node", 2).alias("_node")).agg(F.min(F.shiftright("_ni", 1)).alias("_ni"), F.min(F.shiftright("_nj", 1)).alias("_nj"), F.sum("_n").alias("_n")).select(F.lit(up).alias("_level"), "_node", "_ni", "_nj", "_n")
            made = made.unionByName(layer)
        parents = made.unionByName(full).where(_c("_n") > capacity).select((_c("_level") + 1).alias("_level"), _c("_node").alias("_parent"))
        kept = made.withColumn("_parent", F.shiftright("_node", 2)).join(parents, ["_level", "_parent"], "left_semi").select("_level", "_node", "_ni", "_nj", "_n")
        crowded = (_c("_level") == deepest) & (_c("_n") > capacity)
        kept, n = cut_counted(kept, "cells", crowded)
        found, full = found.unionByName(kept), kept.where(crowded)
    return found


def nearest(left: DataFrame, left_key: str, right: DataFrame, right_key: str, k: int = 1, apart: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """left_key, right_key, d and rank: the ``k`` nearest rows of ``right`` for each row of ``left`` (x, z), of equally near ones the smaller
    keys; with ``apart``, other rows than those of the same key. Keys of either side are unique, and their names differ.

    Rows at places that aren't finite numbers neither ask nor answer; all rows of ``right`` answer where it has fewer than ``k``.
    """
    wanted = k + 1 if apart else k
    capacity = max(capacity, 2 * wanted)
    finite = lambda rows: rows.where("abs(x) < double('Infinity') AND abs(z) < double('Infinity')")
    place = Window.partitionBy("x", "z").orderBy(right_key)
    few = finite(right.select(right_key, "x", "z")).withColumn("_r", F.row_number().over(place)).where(_c("_r") <= wanted).drop("_r")
    few = cut_lineage(few, "places")
    bounds = few.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1")).first()
    asking = finite(left.select(left_key, "x", "z"))
    if bounds["x0"] is None:
        return asking.limit(0).join(few.select(right_key).withColumns({"d": F.lit(0.0), "rank": F.lit(0)}), F.lit(False)).select(left_key, right_key, "d", "rank")
    side = max(bounds["x1"] - bounds["x0"], bounds["z1"] - bounds["z0"])
    square = Square(bounds["x0"], bounds["z0"], side * (1 + 1e-9) if side > 0 and math.isfinite(side) else 1.0)

    coded = cut_lineage(square.coded(few), "coded")
    tree = cut_lineage(nodes(coded, capacity), "tree")
    last = (_c("_n") <= capacity) | (_c("_level") == DEPTH)
    leaves, inner = tree.where(last), tree.where(~last)
    levels = tree.agg(F.array_sort(F.collect_set("_level")).alias("_levels"))  # one row, of DEPTH + 1 levels at most
    each_level = lambda rows: rows.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")
    at_level = lambda rows: each_level(rows).withColumn("_node", _up("_code", f"{DEPTH} - _level"))
    held = cut_lineage(at_level(coded).join(leaves.select("_level", "_node"), ["_level", "_node"]).select("_level", "_node", right_key, _c("x").alias("_x"), _c("z").alias("_z")), "held")

    # The deepest cell with enough points, and how far from the row they are at most.
    asked = cut_lineage(square.coded(asking).select(left_key, "x", "z", "_code"), "asked")
    around = at_level(asked).join(tree.where((_c("_n") >= wanted) | (_c("_level") == 0)).withColumn("_leaf", last), ["_level", "_node"])
    deepest = around.groupBy(left_key).agg(F.max_by(F.struct("x", "z", "_level", "_node", "_ni", "_nj", "_n", "_leaf"), "_level").alias("_b")).select(left_key, "_b.*")
    deepest = cut_lineage(deepest.withColumn("_far", F.when(_c("_n") < wanted, F.lit(math.inf)).otherwise(square.reach(nearest=False))), "deepest")
    apart_by = G.distance(_c("x"), _c("z"), _c("_x"), _c("_z"))
    own = deepest.where("_leaf").select(left_key, "x", "z", "_level", "_node").join(held, ["_level", "_node"]).groupBy(left_key).agg(F.array_sort(F.collect_list(apart_by)).alias("_d"))  # a leaf's points
    radius = F.least("_far", F.coalesce(F.get("_d", F.lit(wanted - 1)), F.lit(math.inf)))
    circles = deepest.select(left_key, "x", "z", "_far").join(own, left_key, "left").select(left_key, "x", "z", (radius * (1 + 1e-12)).alias("_radius"))

    # Two by two cells that hold the circle, and what of the tree is at them, above them or below them.
    fit = F.floor(F.log2(F.lit(square.side) / (2 * _c("_radius")))).cast("int")
    sized = circles.withColumn("_at", F.when(_c("_radius") > 0, F.greatest(F.least(F.coalesce(fit, F.lit(0)), F.lit(DEPTH)), F.lit(0))).otherwise(F.lit(DEPTH)))
    span = lambda v, origin: F.explode(F.sequence(square.index(_c(v) - _c("_radius"), origin, _c("_at")), square.index(_c(v) + _c("_radius"), origin, _c("_at"))))
    covers = sized.withColumn("_i", span("x", square.x0)).withColumn("_j", span("z", square.z0)).withColumn("_code", _interleaved(_c("_i"), _c("_j"))).drop("_i", "_j")
    covers = cut_lineage(covers, "covers")
    above = each_level(covers).where("_level <= _at").withColumn("_node", F.expr("shiftright(_code, CAST(2 * (_at - _level) AS INT))"))
    fields = [left_key, "x", "z", "_radius", "_level", "_node"]
    within = square.reach(nearest=True) <= _c("_radius")
    ends = [cut_lineage(above.select(*fields).distinct().join(leaves, ["_level", "_node"]).where(within).select(*fields), "ends")]
    front, n = cut_counted(covers.withColumnsRenamed({"_at": "_level", "_code": "_node"}).join(inner, ["_level", "_node"]).where(within).select(*fields), "front")
    children = tree.withColumn("_leaf", last).withColumns({"_parent": F.shiftright("_node", 2), "_above": _c("_level") - 1})
    while n:
        down = front.select(left_key, "x", "z", "_radius", _c("_level").alias("_above"), _c("_node").alias("_parent")).join(children, ["_above", "_parent"]).where(within)
        down, n = cut_counted(down.select(*fields, "_leaf"), "down", ~_c("_leaf"))
        ends.append(down.where("_leaf").select(*fields))
        front = down.where("NOT _leaf").select(*fields)
    pairs = ends[0]
    for more in ends[1:]:
        pairs = pairs.unionByName(more)
    met = pairs.join(held, ["_level", "_node"]).withColumn("d", apart_by).where(_c("d") <= _c("_radius"))
    if apart:
        met = met.where(_c(left_key) != _c(right_key))
    order = Window.partitionBy(left_key).orderBy("d", right_key)
    return met.withColumn("rank", F.row_number().over(order)).where(_c("rank") <= k).select(left_key, right_key, "d", "rank")
