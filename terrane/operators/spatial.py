"""Spatial joins in the plane, each an equi-join on grid cells with an exact test behind it, never a bare inequality join.

The cell size is the search radius (or a parameter), so that a row meets the rows of its own and the eight cells around. Cells in which
many rows lie are skewed join keys, which adaptive execution splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import scanline
from terrane.sources.tables import cut_counted, cut_lineage


def _cell(x: str | Column, size: float) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / size).cast("long")


def _around(df: DataFrame, size: float) -> DataFrame:
    """Each row once for its own cell and each of the eight around."""
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("_o", F.explode(moves)).withColumns({"_cx": _cell("x", size) + F.col("_o.i"), "_cz": _cell("z", size) + F.col("_o.j")}).drop("_o")


def within_radius(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of rows at most ``radius`` apart, with their distance d. Both sides have x and z; all other columns must differ."""
    b = right.withColumns({"_cx": _cell("x", radius), "_cz": _cell("z", radius)}).withColumnsRenamed({"x": "_x2", "z": "_z2"})
    pairs = _around(left, radius).join(b, ["_cx", "_cz"]).withColumn("d", G.distance(F.col("x"), F.col("z"), F.col("_x2"), F.col("_z2")))
    return pairs.where(F.col("d") <= radius).drop("_cx", "_cz", "_x2", "_z2")


def neighbour_counts(points: DataFrame, key: str, radius: float) -> DataFrame:
    """How many other points lie within the radius of each."""
    other = points.select(F.col(key).alias("_k"), "x", "z")
    near = within_radius(points.select(key, "x", "z"), other, radius).where(F.col(key) != F.col("_k")).groupBy(key).agg(F.count("*").alias("n"))
    return points.select(key).join(near, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def nearest_within(left: DataFrame, left_key: str, right: DataFrame, right_key: str, radius: float, k: int) -> DataFrame:
    """The ``k`` nearest rows of ``right`` within the radius of each row of ``left``; of equally near ones the smaller keys."""
    order = Window.partitionBy(left_key).orderBy("d", right_key)
    return within_radius(left, right, radius).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _widening(todo: DataFrame, key: str, start: float, search) -> DataFrame:
    """``search(rows, radius)`` on all rows, then with a fourfold radius on those that found nothing, and so on. Rounds are written to the shared folder."""
    found, radius, n = None, start, 1
    while n:
        hit = cut_lineage(search(todo, radius), "hit")
        found = hit if found is None else found.unionByName(hit)
        todo, n = cut_counted(todo.join(hit.select(key), key, "left_anti"), "todo")
        radius *= 4
    return found


def _finite(rows: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.where(~F.isnan(c) & (F.abs(c) < math.inf))
    return rows


def nearest(left: DataFrame, left_key: str, right: DataFrame, right_key: str, start: float) -> DataFrame:
    """left_key, right_key and d of the nearest row of ``right`` however far: the radius grows fourfold until every row has found one.

    Rows at places that aren't finite numbers find nothing and are left out; nothing is found where ``right`` has no row.
    """
    rows, right = _finite(left.select(left_key, "x", "z"), "x", "z"), _finite(right.select(right_key, "x", "z"), "x", "z")
    search = lambda todo, radius: nearest_within(todo, left_key, right, right_key, radius, 1).select(left_key, right_key, "d")
    return search(rows, start) if right.isEmpty() else _widening(rows, left_key, start, search)


def nearest_segment_any(points: DataFrame, key: str, edges: DataFrame, edge_key: str, start: float) -> DataFrame:
    """key, edge_key and d of the nearest segment of each point however far, in widening rounds like ``nearest``."""
    rows, edges = _finite(points.select(key, "x", "z"), "x", "z"), _finite(edges, "x1", "z1", "x2", "z2")
    search = lambda todo, radius: nearest_segment(todo, key, edges, edge_key, radius)
    return search(rows, start) if edges.isEmpty() else _widening(rows, key, start, search)


def _segment_cells(edges: DataFrame, size: float, reach: float) -> DataFrame:
    """Each segment (x1 z1 x2 z2) once for every cell that a point within ``reach`` of it can lie in: column by column, so that cells grow with
    a segment's length, not with the area of its bounds."""
    low = lambda a, b: F.floor((F.least(a, b) - reach) / size).cast("long")
    high = lambda a, b: F.floor((F.greatest(a, b) + reach) / size).cast("long")
    columns = edges.withColumn("_cx", F.explode(F.sequence(low("x1", "x2"), high("x1", "x2"))))
    along = F.col("x2") - F.col("x1")
    share = lambda x: F.when(along == 0, None).otherwise(F.least(F.greatest((x - F.col("x1")) / along, F.lit(0.0)), F.lit(1.0)))
    at = lambda t, end: F.coalesce(F.col("z1") + (F.col("z2") - F.col("z1")) * t, F.col(end))
    za, zb = at(share(F.col("_cx") * size - reach), "z1"), at(share((F.col("_cx") + 1) * size + reach), "z2")
    # A little more than reach: the ends are rounded.
    slack = reach + size * 1e-9
    return columns.withColumn("_cz", F.explode(F.sequence(F.floor((F.least(za, zb) - slack) / size).cast("long"), F.floor((F.greatest(za, zb) + slack) / size).cast("long"))))


def nearest_segment(points: DataFrame, key: str, edges: DataFrame, edge_key: str, radius: float) -> DataFrame:
    """key, edge_key and d of the nearest segment within the radius of each point."""
    keyed = points.select(key, "x", "z", _cell("x", radius).alias("_cx"), _cell("z", radius).alias("_cz"))
    pairs = keyed.join(_segment_cells(edges, radius, radius), ["_cx", "_cz"])
    c = F.col
    pairs = pairs.withColumn("d", G.segment_distance(c("x"), c("z"), c("x1"), c("z1"), c("x2"), c("z2"))).where(c("d") <= radius)
    return pairs.groupBy(key).agg(F.min(F.struct("d", edge_key)).alias("_m")).select(key, F.col(f"_m.{edge_key}").alias(edge_key), F.col("_m.d").alias("d"))


# Where cells begin, as shares of their size: no place that data prefer, so that no corner of a cell lies on an edge.
_OFF_X, _OFF_Z = 0.381966011250105, 0.236067977499790


def points_in_polygons(points: DataFrame, key: str, edges: DataFrame, polygon: str, size: float) -> DataFrame:
    """key and polygon of every point inside a polygon, given by its edges (x1 z1 x2 z2): an odd number of edges crosses the ray to greater x.

    Points in cells that no edge touches meet the runs of inner cells. In a cell that edges touch, only these are tested: the way from the
    point to the cell's right side and along it to the middle of the row crosses them, and from there on the row's crossings are
    counted. What is handled grows with the borders of polygons and not with their areas.
    """
    c = F.col
    edges, points = _finite(edges, "x1", "z1", "x2", "z2"), _finite(points, "x", "z")
    x0, z0 = F.lit(_OFF_X * size), F.lit(_OFF_Z * size)
    cell = lambda v, origin: F.floor((v - origin) / size).cast("long")
    moved = edges.select(polygon, (c("x1") - x0).alias("x1"), (c("z1") - z0).alias("z1"), (c("x2") - x0).alias("x2"), (c("z2") - z0).alias("z2"), F.struct("x1", "z1", "x2", "z2").alias("_e"))
    placed = cut_lineage(_segment_cells(moved, size, 0.0).select(polygon, "_cx", "_cz", "_e"), "border")
    crossed = scanline.crossings(edges, [polygon], size, x0, z0).select(polygon, "_cz", cell(c("_x"), x0).alias("_cx"), F.lit(1).alias("_k"))
    marks = placed.select(polygon, "_cz", "_cx", F.lit(0).alias("_k")).unionByName(crossed).groupBy(polygon, "_cz", "_cx").agg(F.sum("_k").alias("_k"))
    along = Window.partitionBy(polygon, "_cz").orderBy(F.desc("_cx"))
    beyond = F.coalesce(F.sum("_k").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = cut_lineage(marks.select(polygon, "_cz", "_cx", beyond.alias("_beyond"), F.lag("_cx").over(along).alias("_next")), "rows")
    inner = border.where("_beyond % 2 = 1 AND _next > _cx + 1").select(polygon, "_cz", (c("_cx") + 1).alias("from_ix"), (c("_next") - 1).alias("to_ix"))
    pieces = cut_lineage(scanline.aligned(inner).select(polygon, "_cz", "_level", "_index"), "inner")

    keyed = points.select(key, "x", "z", cell(c("x"), x0).alias("_cx"), cell(c("z"), z0).alias("_cz"))
    levels = pieces.agg(F.array_sort(F.collect_set("_level")).alias("_levels"))  # one row, of 60 levels at most
    asked = keyed.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels"))
    whole = asked.withColumn("_index", F.floor(c("_cx") / F.pow(F.lit(2.0), c("_level"))).cast("long")).join(pieces, ["_cz", "_level", "_index"]).select(key, polygon)

    side, middle = x0 + (c("_cx") + 1) * size, scanline.middle(c("_cz"), z0, size)
    e = {n: c(f"_e.{n}") for n in ("x1", "z1", "x2", "z2")}
    over = (e["z1"] > c("z")) != (e["z2"] > c("z"))
    x = (e["x2"] - e["x1"]) * (c("z") - e["z1"]) / F.when(over, e["z2"] - e["z1"]) + e["x1"]
    aside = (e["x1"] > side) != (e["x2"] > side)
    z = (e["z2"] - e["z1"]) * (side - e["x1"]) / F.when(aside, e["x2"] - e["x1"]) + e["z1"]
    steps = F.coalesce((over & (c("x") < x) & (x <= side)).cast("int"), F.lit(0)) + F.coalesce((aside & ((z > c("z")) != (z > middle))).cast("int"), F.lit(0))
    near = keyed.join(placed, ["_cx", "_cz"]).groupBy(key, polygon, "_cx", "_cz").agg(F.sum(steps).alias("_n"), F.count("*").alias("_edges"))
    own = near.join(border.select(polygon, "_cz", "_cx", "_beyond"), [polygon, "_cz", "_cx"]).where("(_n + _beyond) % 2 = 1").select(key, polygon)
    return whole.unionByName(own)


def overlapping_boxes(boxes: DataFrame, key: str, size: float) -> DataFrame:
    """Pairs a < b of boxes (x0 x1 z0 z1) that overlap, and the area they share.

    Boxes lie on levels whose cells double in size, each where it covers two by two cells at most, and meet larger ones on their
    levels: no box is spread over many cells. A pair is taken at the cell of its shared corner.
    """
    names = (key, "x0", "x1", "z0", "z1")
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0"))
    own = boxes.select(*names, F.greatest(F.ceil(F.log2(wide / size)), F.lit(0)).cast("int").alias("_own"))
    own = own.withColumn("_own", F.coalesce("_own", F.lit(0)))
    top = own.agg(F.max("_own").alias("_top"))  # one row

    def placed(df: DataFrame, p: str) -> DataFrame:
        cell = size * F.pow(F.lit(2.0), F.col("_level"))
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long")))
        return df.withColumn("_cx", span("x0", "x1")).withColumn("_cz", span("z0", "z1")).withColumnsRenamed({c: f"{p}_{c}" for c in (*names, "_own")})

    a = placed(own.crossJoin(F.broadcast(top)).withColumn("_level", F.explode(F.sequence("_own", "_top"))).drop("_top"), "a")
    b = placed(own.withColumn("_level", F.col("_own")), "b")
    c = F.col
    pairs = a.join(b, ["_level", "_cx", "_cz"]).where((c("a__own") < c("b__own")) | (c(f"a_{key}") < c(f"b_{key}"))).where(c(f"a_{key}") != c(f"b_{key}"))
    pairs = pairs.where("a_x0 < b_x1 AND b_x0 < a_x1 AND a_z0 < b_z1 AND b_z0 < a_z1")
    cell = size * F.pow(F.lit(2.0), c("_level"))
    corner = lambda n: F.floor(F.greatest(f"a_{n}0", f"b_{n}0") / cell).cast("long")
    pairs = pairs.where((c("_cx") == corner("x")) & (c("_cz") == corner("z")))
    area = (F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")) * (F.least("a_z1", "b_z1") - F.greatest("a_z0", "b_z0"))
    return pairs.select(F.least(f"a_{key}", f"b_{key}").alias("a"), F.greatest(f"a_{key}", f"b_{key}").alias("b"), area.alias("area"))


def meeting_polygons(edges: DataFrame, polygon: str, i: str, size: float) -> DataFrame:
    """Pairs a < b of polygons, given by their edges, of which edges cross or touch, or one holds a vertex of the other."""
    names = ("x1", "z1", "x2", "z2")
    placed = _segment_cells(edges.select(polygon, *names), size, 0.0)
    a = placed.withColumnsRenamed({c: f"a_{c}" for c in (polygon, *names)})
    b = placed.withColumnsRenamed({c: f"b_{c}" for c in (polygon, *names)})
    met = a.join(b, ["_cx", "_cz"]).where((F.col(f"a_{polygon}") < F.col(f"b_{polygon}")) & G.segments_touch("a_", "b_"))
    vertices = edges.select(F.struct(polygon, i).alias("_v"), F.col("x1").alias("x"), F.col("z1").alias("z"))
    inside = points_in_polygons(vertices, "_v", edges, polygon, size).select(F.col(f"_v.{polygon}").alias("_p"), polygon).where(F.col("_p") != F.col(polygon))
    pairs = met.select(F.col(f"a_{polygon}").alias("a"), F.col(f"b_{polygon}").alias("b"))
    return pairs.unionByName(inside.select(F.least("_p", polygon).alias("a"), F.greatest("_p", polygon).alias("b"))).distinct()


def self_crossings(edges: DataFrame, ring: str, i: str, n: str, size: float) -> DataFrame:
    """Pairs of edges of a ring (numbered from 0, n in all) that cross and aren't neighbours; edges meet by cells of ``size``."""
    names = (i, "x1", "z1", "x2", "z2")
    placed = _segment_cells(edges.select(ring, n, *names), size, 0.0)
    a = placed.select(ring, n, "_cx", "_cz", *[F.col(x).alias(f"a_{x}") for x in names])
    b = placed.select(ring, "_cx", "_cz", *[F.col(x).alias(f"b_{x}") for x in names])
    apart = (F.col(f"a_{i}") + 2 <= F.col(f"b_{i}")) & ~((F.col(f"a_{i}") == 0) & (F.col(f"b_{i}") == F.col(n) - 1))
    return a.join(b, [ring, "_cx", "_cz"]).where(apart & G.segments_cross("a_", "b_")).select(ring, F.col(f"a_{i}").alias("i"), F.col(f"b_{i}").alias("j")).distinct()


def densified(edges: DataFrame, step: float) -> DataFrame:
    """Points along each segment, at most ``step`` apart, with their number k; the end is the next segment's first point."""
    length = G.distance(F.col("x1"), F.col("z1"), F.col("x2"), F.col("z2"))
    parts = F.greatest(F.ceil(length / step).cast("int"), F.lit(1))
    out = edges.withColumn("_n", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("k") / F.col("_n")
    return out.withColumns({"x": F.col("x1") + (F.col("x2") - F.col("x1")) * t, "z": F.col("z1") + (F.col("z2") - F.col("z1")) * t}).drop("_n")


def clipped_lines(points: DataFrame, line: str, edges: DataFrame, polygon: str, pad: float, size: float) -> DataFrame:
    """polygon, line, run (from 0), i, x, z: the runs of two points at least that stay of lines (line, i, x, z) clipped to polygons (their edges).

    A point stays that lies in the polygon or within ``pad`` of its border, and so do both ends of a segment that meets the border.
    """
    own = cut_lineage(points.select(line, "i", "x", "z"), "points")
    keyed = own.select(F.struct(line, "i").alias("_p"), "x", "z")
    inside = points_in_polygons(keyed, "_p", edges, polygon, size).select("_p", polygon)
    borders = edges.select(polygon, "x1", "z1", "x2", "z2")
    cells = keyed.select("_p", "x", "z", _cell("x", size).alias("_cx"), _cell("z", size).alias("_cz"))
    c = F.col
    near = cells.join(_segment_cells(borders, size, pad), ["_cx", "_cz"]).where(G.segment_distance(c("x"), c("z"), c("x1"), c("z1"), c("x2"), c("z2")) <= pad).select("_p", polygon)
    order = Window.partitionBy(line).orderBy("i")
    segments = own.select(line, "i", F.lead("i").over(order).alias("_j"), c("x").alias("x1"), c("z").alias("z1"), F.lead("x").over(order).alias("x2"), F.lead("z").over(order).alias("z2")).where("_j IS NOT NULL")
    a = _segment_cells(segments, size, 0.0).withColumnsRenamed({n: f"a_{n}" for n in ("x1", "z1", "x2", "z2")})
    b = _segment_cells(borders, size, 0.0).withColumnsRenamed({n: f"b_{n}" for n in ("x1", "z1", "x2", "z2")})
    hit = a.join(b, ["_cx", "_cz"]).where(G.segments_touch("a_", "b_")).select(polygon, line, F.explode(F.array("i", "_j")).alias("i"))
    kept = inside.unionByName(near).select(polygon, f"_p.{line}", "_p.i").unionByName(hit).distinct()
    numbered = own.withColumn("_k", F.row_number().over(order))
    met = kept.join(numbered, [line, "i"])
    by = Window.partitionBy(polygon, line)
    runs = met.withColumn("_g", c("_k") - F.row_number().over(by.orderBy("_k"))).withColumn("_n", F.count("*").over(Window.partitionBy(polygon, line, "_g"))).where("_n >= 2")
    return runs.withColumn("run", F.dense_rank().over(by.orderBy("_g")) - 1).select(polygon, line, "run", "i", "x", "z")
