"""Rules on buildings, doors, roads, water, trees, plants and meshes: each returns the rows that break it, with severity and score.

Buildings have id, kind, shape, ground, eave, ridge; ``edges`` are their footprints (id, i, x1, z1, x2, z2, against the clock); road axes are
segments (road, kind, width, drivable, i, x1, z1, x2, z2). Areas come from sample points in the footprints, which meet segments and
polygons by grid cell. Findings have check, severity (FAIL, WARN, INFO), id and score; larger scores are worse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import scanline
from terrane.operators import spatial as J

# Least wall height, and heights beyond which to warn and to fail, by kind of building.
WALL_HEIGHTS = {"house": (2.2, 9.0, 16.0), "shed": (1.8, 5.5, 12.0), "garage": (2.0, 4.5, 10.0), "barn": (2.0, 12.0, 20.0), "hall": (2.5, 14.0, 25.0), "public": (2.5, 15.0, 30.0), "church": (2.5, 40.0, 70.0)}
OTHER_WALL_HEIGHTS = (2.0, 12.0, 25.0)
# Limits of the other rules, in metres, square metres, degrees and shares.
SLENDER, PITCH, PITCH_FAIL, FLAT = 1.6, (8.0, 62.0), 75.0, 0.3
# From which the scores of walls in the wrong order, and of pitches, are counted.
ORDER_SCORE, USUAL_PITCH = 100, 35
OVERLAP, OVERLAP_FAIL = 0.5, 0.3
ROAD_AREA, ROAD_DEPTH, ROAD_AREA_FAIL, ROAD_DEPTH_FAIL, PATH_AREA = 1.0, 0.3, 10.0, 1.5, 3.0
DOOR_OFF, DOOR_OFF_FAIL, DOOR_COS, DOOR_NEAR, DOOR_EXTRA = 0.3, 2.0, -0.3, 2.0, 8.0
GROUND_MEAN, GROUND_MOST, GROUND_MEAN_FAIL, GROUND_MOST_FAIL = 0.15, 0.5, 0.6, 2.0
STEP, STEP_OVER, STEP_FAIL, GRADE, GRADE_FAIL, GRADE_LENGTH, GRADE_LENGTH_FAIL, CROSS, CROSS_FAIL = 0.35, 0.25, 1.0, 0.15, 0.25, 20.0, 10.0, 0.10, 0.25
TREE_HEIGHT, TREE_SUNK, TREE_DEPTH, TREE_AXIS, TREE_INSIDE = (-0.6, 0.1), -3.0, 0.3, 1.0, 1.0
PLANT_SHARE, PLANT_SHARE_FAIL, PLANT_DEPTH, PLANT_HEIGHT = 0.002, 0.05, 0.2, (-0.3, 0.15)
FLAT_TRIANGLE, FLAT_SHARE, NORMAL, WALL_GAP, WALL_GAP_FAIL, WALL_DEEP, ROOF_TOP = 1e-6, 0.001, 0.02, 0.15, 0.5, 1.5, 0.6

#: Cells in which edges of a footprint meet, in metres.
CROSSING_CELL = 4.0

_c = F.col


def _finding(check: str, severity: Column, score: Column, key: str = "id") -> list[Column]:
    return [F.lit(check).alias("check"), severity.alias("severity"), _c(key).alias("id"), score.cast("double").alias("score")]


def areas(edges: DataFrame) -> DataFrame:
    """id and area of each footprint."""
    return edges.groupBy("id").agg(F.abs(F.sum(_c("x1") * _c("z2") - _c("x2") * _c("z1")) / 2).alias("area"))


def samples(edges: DataFrame, step: float) -> DataFrame:
    """id, x, z: points of a grid from each footprint's corner that lie in the footprint, row by row between its crossings.

    Spark takes the points for no more rows than there are edges, and would send them through the driver to all executors where they meet something
    else; they are hinted to be shuffled.
    """
    corner = edges.groupBy("id").agg(F.min(F.least("x1", "x2")).alias("x0"), F.min(F.least("z1", "z2")).alias("z0"))
    inner = scanline.runs(edges.join(corner, "id"), "id", step, _c("x0"), _c("z0")).join(corner, "id")
    points = inner.withColumn("ix", F.explode(F.sequence("from_ix", "to_ix")))
    return points.select("id", scanline.middle(_c("ix"), _c("x0"), step).alias("x"), scanline.middle(_c("iz"), _c("z0"), step).alias("z")).hint("merge")


def road_depths(points: DataFrame, keys: list[str], segments: DataFrame, reach: float) -> DataFrame:
    """keys, x, z and the road in whose width a point lies deepest (road, kind, drivable, width), with depth = width / 2 - distance from the
    axis; of equally deep ones the smallest road. ``reach`` is at least half the width of every road."""
    keyed = points.select(*keys, "x", "z", J._cell("x", reach).alias("_cx"), J._cell("z", reach).alias("_cz"))
    met = keyed.join(J._segment_cells(segments, reach, reach), ["_cx", "_cz"])
    depth = _c("width") / 2 - G.segment_distance(_c("x"), _c("z"), _c("x1"), _c("z1"), _c("x2"), _c("z2"))
    deep = met.withColumn("depth", depth).where("depth > 0")
    best = F.min_by(F.struct("road", "kind", "drivable", "width", "depth"), F.struct(-_c("depth"), _c("road")))
    return deep.groupBy(*keys, "x", "z").agg(best.alias("_b")).select(*keys, "x", "z", "_b.*")


def wall_heights(buildings: DataFrame, edges: DataFrame) -> DataFrame:
    """Eaves under the ground, ridges under the eaves; walls too high or low for their kind, or for their area."""
    of = lambda i: F.coalesce(*[F.when(_c("kind") == k, F.lit(v[i])) for k, v in WALL_HEIGHTS.items()], F.lit(OTHER_WALL_HEIGHTS[i]))
    rows = buildings.join(areas(edges), "id").withColumn("wall", _c("eave") - _c("ground"))
    ordered = rows.where("NOT ground < eave").select(*_finding("order", F.lit("FAIL"), ORDER_SCORE - _c("wall")))
    low = rows.where("ground < eave AND ridge < eave - 0.01").select(*_finding("order", F.lit("FAIL"), _c("eave") - _c("ridge")))
    slender = _c("wall") / F.sqrt(F.greatest("area", F.lit(1.0))) > SLENDER
    severity = F.when(_c("wall") > of(2), "FAIL").when((_c("wall") > of(1)) | (_c("wall") < of(0)) | slender, "WARN")
    rest = rows.where("ground < eave AND ridge >= eave - 0.01").withColumn("_s", severity).where("_s IS NOT NULL")
    return ordered.unionByName(low).unionByName(rest.select(*_finding("wall", _c("_s"), _c("wall"))))


def roofs(buildings: DataFrame, edges: DataFrame) -> DataFrame:
    """Flat roofs with a ridge; pitches out of bounds, by half the extent across the ridge (dir_x, dir_z); ridges beside the footprint."""
    fine = buildings.where("ground < eave AND ridge >= eave - 0.01").withColumn("_rise", _c("ridge") - _c("eave"))
    flat = fine.where((_c("shape") == "flat") & (F.abs("_rise") > FLAT)).select(*_finding("roof_flat", F.lit("WARN"), _c("_rise")))
    pitched = fine.where("shape <> 'flat'")
    norm = F.sqrt(_c("dir_x") * _c("dir_x") + _c("dir_z") * _c("dir_z"))
    across = (-_c("dir_z") / norm) * _c("x1") + (_c("dir_x") / norm) * _c("z1")
    spans = pitched.join(edges, "id").groupBy("id").agg(((F.max(across) - F.min(across)) / 2).alias("_half"))
    angle = F.degrees(F.atan2(_c("_rise"), F.greatest("_half", F.lit(0.1))))
    steep = F.when(_c("_rise") <= 0.05, "WARN").when(_c("_a") > PITCH_FAIL, "FAIL").when(~_c("_a").between(*PITCH), "WARN")
    score = F.when(_c("_rise") <= 0.05, 1.0).when(_c("_a") > PITCH_FAIL, _c("_a")).otherwise(F.abs(_c("_a") - USUAL_PITCH))
    pitches = pitched.join(spans, "id").withColumn("_a", angle).withColumn("_s", steep).where("_s IS NOT NULL").select(*_finding("roof_pitch", _c("_s"), score))
    centres = pitched.where("ridge_x IS NOT NULL").select("id", _c("ridge_x").alias("x"), _c("ridge_z").alias("z")).join(edges, "id")
    crossing = G.crosses_ray(_c("x"), _c("z"), _c("x1"), _c("z1"), _c("x2"), _c("z2"))
    far = G.segment_distance(_c("x"), _c("z"), _c("x1"), _c("z1"), _c("x2"), _c("z2"))
    beside = centres.groupBy("id").agg(F.sum(crossing.cast("int")).alias("_n"), F.min(far).alias("_d")).where("_n % 2 = 0 AND _d > 0.5")
    return flat.unionByName(pitches).unionByName(beside.select(*_finding("roof_beside", F.lit("WARN"), _c("_d"))))


def footprints(edges: DataFrame) -> DataFrame:
    """Footprints whose edges cross, and those of under three vertices or two square metres."""
    counted = edges.withColumn("n", F.count("*").over(Window.partitionBy("id")))
    crossed = J.self_crossings(counted, "id", "i", "n", CROSSING_CELL).groupBy("id").agg(F.count("*").alias("_k"))
    small = edges.groupBy("id").agg(F.count("*").alias("_n")).join(areas(edges), "id").where("_n < 3 OR area < 2")
    return crossed.select(*_finding("crossed", F.when(_c("_k") > 2, "FAIL").otherwise("WARN"), _c("_k"))).unionByName(small.select(*_finding("small", F.lit("WARN"), F.lit(1.0))))


def overlaps(edges: DataFrame, step: float = 0.2, size: float = 8.0) -> DataFrame:
    """Pairs of footprints (id < other) that share over ``OVERLAP`` square metres, by points of a grid in the bounds they share."""
    low, high = lambda c: F.min(F.least(f"{c}1", f"{c}2")), lambda c: F.max(F.greatest(f"{c}1", f"{c}2"))
    boxes = edges.groupBy("id").agg(low("x").alias("x0"), high("x").alias("x1"), low("z").alias("z0"), high("z").alias("z1"))
    a, b = (boxes.select(_c("id").alias(n), *[_c(c).alias(f"{n}_{c}") for c in ("x0", "x1", "z0", "z1")]) for n in ("a", "b"))
    pairs = J.overlapping_boxes(boxes, "id", size).select("a", "b").join(a, "a").join(b, "b")
    steps = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.least(f"a_{c}1", f"b_{c}1") - F.greatest(f"a_{c}0", f"b_{c}0")) / step - 0.5).cast("int"), F.lit(1)) - 1))
    grid = pairs.withColumn("kx", steps("x")).withColumn("kz", steps("z"))
    points = grid.select("a", "b", "kx", "kz", (F.greatest("a_x0", "b_x0") + step / 2 + _c("kx") * step).alias("x"), (F.greatest("a_z0", "b_z0") + step / 2 + _c("kz") * step).alias("z"))
    crossing = G.crosses_ray(_c("x"), _c("z"), _c("x1"), _c("z1"), _c("x2"), _c("z2"))
    for side in ("a", "b"):
        met = points.join(edges.withColumnRenamed("id", side), side)
        points = met.groupBy("a", "b", "kx", "kz", "x", "z").agg(F.sum(crossing.cast("int")).alias("_n")).where("_n % 2 = 1").drop("_n")
    shared = points.groupBy("a", "b").agg((F.count("*") * step * step).alias("_m2")).where(_c("_m2") > OVERLAP)
    size_of = lambda n: areas(edges).select(_c("id").alias(n), _c("area").alias(f"_{n}"))
    part = _c("_m2") / F.greatest(F.least("_a", "_b"), F.lit(1e-6))
    met = shared.join(size_of("a"), "a").join(size_of("b"), "b").withColumn("_s", F.when(part > OVERLAP_FAIL, "FAIL").otherwise("WARN"))
    return met.select(*_finding("overlap", _c("_s"), _c("_m2"), "a"), _c("b").alias("other"))


def buildings_on_roads(edges: DataFrame, segments: DataFrame, reach: float, step: float = 0.25) -> DataFrame:
    """Buildings that reach into the width of a road: area and depth, apart for roads to drive on and paths."""
    deep = road_depths(samples(edges, step), ["id"], segments, reach)
    by = deep.groupBy("id", "drivable").agg((F.count("*") * step * step).alias("_m2"), F.max("depth").alias("_d"))
    driven = F.when((_c("_m2") > ROAD_AREA_FAIL) & (_c("_d") > ROAD_DEPTH_FAIL), "FAIL").when((_c("_m2") > ROAD_AREA) & (_c("_d") > ROAD_DEPTH), "WARN").otherwise("INFO")
    path = F.when((_c("_m2") > PATH_AREA) & (_c("_d") > ROAD_DEPTH), "WARN").otherwise("INFO")
    return by.select(*_finding("on_road", F.when(_c("drivable"), driven).otherwise(path), _c("_m2")), "drivable", _c("_d").alias("depth"))


def doors(buildings: DataFrame, edges: DataFrame, segments: DataFrame, start: float) -> DataFrame:
    """Doors (door_x, door_z) off the footprint's edges; doors on a side that faces away from the nearest road, although other vertices or
    midpoints of the footprint are much nearer to it. ``segments`` are roads to drive on; distances are to points along their axes."""
    own = buildings.where("door_x IS NOT NULL").select("id", _c("door_x").alias("x"), _c("door_z").alias("z"))
    met = own.join(edges, "id")
    c = ("x", "z", "x1", "z1", "x2", "z2")
    met = met.withColumns({"_d": G.segment_distance(*map(_c, c)), "_t": G.along_segment(*map(_c, c)), "_n": F.count("*").over(Window.partitionBy("id"))})
    nearest = met.groupBy("id").agg(F.min_by(F.struct("i", "_d", "_t", "_n"), F.struct("_d", "i")).alias("_e"))
    off = nearest.where(_c("_e._d") > DOOR_OFF).select(*_finding("door_off", F.when(_c("_e._d") > DOOR_OFF_FAIL, "FAIL").otherwise("WARN"), _c("_e._d")))
    axis = segments.select(F.concat_ws(":", "road", "i").alias("p"), _c("x1").alias("x"), _c("z1").alias("z"))  # points along the axes
    at = axis.withColumnsRenamed({"x": "px", "z": "pz"})
    to_road = J.nearest(own, "id", axis, "p", start).join(at, "p").join(own, "id")
    corner = edges.select(F.struct("id", "i", F.lit(0).alias("m")).alias("v"), _c("x1").alias("x"), _c("z1").alias("z"))
    middle = edges.select(F.struct("id", "i", F.lit(1).alias("m")).alias("v"), ((_c("x1") + _c("x2")) / 2).alias("x"), ((_c("z1") + _c("z2")) / 2).alias("z"))
    closest = J.nearest(corner.unionByName(middle), "v", axis, "p", start).groupBy(_c("v.id").alias("id")).agg(F.min("d").alias("_least"))
    beside = F.when(_c("_e._t") < 0.05, F.pmod(_c("_e.i") - 1, _c("_e._n"))).when(_c("_e._t") > 0.95, F.pmod(_c("_e.i") + 1, _c("_e._n")))
    sides = nearest.select("id", F.explode(F.array_distinct(F.array_compact(F.array(_c("_e.i").cast("long"), beside.cast("long"))))).alias("i")).join(edges.withColumn("i", _c("i").cast("long")), ["id", "i"])
    ex, ez = _c("x2") - _c("x1"), _c("z2") - _c("z1")
    long = F.sqrt(ex * ex + ez * ez)
    far = F.greatest("d", F.lit(1e-6))
    cosine = (ez * (_c("px") - _c("x")) - ex * (_c("pz") - _c("z"))) / F.when(long > 0, long).otherwise(1.0) / far
    faced = sides.join(to_road, "id").where(_c("d") > DOOR_NEAR).groupBy("id", "d").agg(F.max(cosine).alias("_cos"))
    faced = faced.where(_c("_cos") < DOOR_COS).join(closest, "id").withColumn("_extra", _c("d") - _c("_least"))
    away = F.when(_c("_extra") > DOOR_EXTRA, "WARN").otherwise("INFO")
    return off.unionByName(faced.select(*_finding("door_away", away, F.when(_c("_extra") > DOOR_EXTRA, _c("_extra")).otherwise(-_c("_cos")))))


def buildings_in_water(edges: DataFrame, ponds: DataFrame, streams: DataFrame, size: float = 8.0, step: float = 0.5) -> DataFrame:
    """Buildings over a square metre of which lies in a pond (edges pond, x1 z1 x2 z2), and those that a stream's axis (stream, x1 z1 x2 z2)
    crosses on two points ``step`` apart at least."""
    inside = J.points_in_polygons(samples(edges, step).select(F.struct("id", "x", "z").alias("p"), "x", "z"), "p", ponds, "pond", size)
    wet = inside.groupBy(_c("p.id").alias("id"), "pond").agg(F.count("*").alias("_n")).where(_c("_n") * step * step > 1)
    along = J.densified(streams, step).select(F.struct("stream", "i", "k").alias("p"), "x", "z")
    crossed = J.points_in_polygons(along, "p", edges, "id", size).groupBy("id", "p.stream").agg(F.count("*").alias("_n")).where("_n >= 2")
    pond = wet.select(*_finding("in_pond", F.lit("WARN"), _c("_n")), _c("pond").alias("other"))
    return pond.unionByName(crossed.select(*_finding("in_stream", F.lit("WARN"), _c("_n")), _c("stream").alias("other")))


def items(things: DataFrame, edges: DataFrame, segments: DataFrame, heights: DataFrame, reach: float, allowed: list[str], size: float = 8.0) -> DataFrame:
    """Things (id, kind, x, z) in a building; else those on a road to drive on, unless their kind is ``allowed`` there; and those
    for which ``heights`` (id, h) has none."""
    inside = J.points_in_polygons(things, "id", edges.withColumnRenamed("id", "building"), "building", size).select("id").distinct()
    outside = things.join(inside, "id", "left_anti")
    road = road_depths(outside.where(~_c("kind").isin(allowed)), ["id"], segments, reach).select("id")
    off = outside.join(heights.where("h IS NOT NULL").select("id"), "id", "left_anti")
    parts = [inside.select(*_finding("item_inside", F.lit("WARN"), F.lit(2.0))), road.select(*_finding("item_on_road", F.lit("WARN"), F.lit(1.0))), off.select(*_finding("item_off_grid", F.lit("WARN"), F.lit(1.0)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ground_under(buildings: DataFrame, heights: DataFrame) -> DataFrame:
    """Buildings whose ground differs from the terrain at their sample points (id, h), in the mean or at most; off the grid if some has none."""
    d = _c("h") - _c("ground")
    facts = buildings.join(heights, "id").groupBy("id").agg(F.avg(d).alias("_mean"), F.max(F.abs(d)).alias("_most"), (F.count("*") - F.count("h")).alias("_none"))
    severity = F.when((F.abs("_mean") > GROUND_MEAN_FAIL) | (_c("_most") > GROUND_MOST_FAIL), "FAIL").when((F.abs("_mean") > GROUND_MEAN) | (_c("_most") > GROUND_MOST), "WARN")
    off = facts.where("_none > 0").select(*_finding("ground_off_grid", F.lit("WARN"), F.lit(1.0)))
    return off.unionByName(facts.where("_none = 0").withColumn("_s", severity).where("_s IS NOT NULL").select(*_finding("ground", _c("_s"), _c("_most"))))


def road_steps(profile: DataFrame) -> DataFrame:
    """Roads (road, drivable, k, h in order of k) with steps: a jump that is far from the median of the five jumps around. The worst of each."""
    w, whole = Window.partitionBy("road").orderBy("k"), Window.partitionBy("road").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    jumps = profile.withColumn("_j", F.lead("h").over(w) - _c("h")).where("_j IS NOT NULL")
    near = [F.coalesce(F.lag("_j", 2).over(w), F.first("_j").over(whole)), F.coalesce(F.lag("_j", 1).over(w), F.first("_j").over(whole)), _c("_j"), F.coalesce(F.lead("_j", 1).over(w), F.last("_j").over(whole)), F.coalesce(F.lead("_j", 2).over(w), F.last("_j").over(whole))]
    judged = jumps.withColumns({"_m": F.element_at(F.array_sort(F.array(*near)), 3), "_n": F.count("*").over(whole)})
    over = F.abs(_c("_j") - _c("_m"))
    found = judged.where("_n >= 5").where((F.abs("_j") > STEP) & (over > STEP_OVER)).groupBy("road", "drivable").agg(F.max_by(F.struct("_j", over.alias("o")), F.struct(over, -_c("k"))).alias("_b"))
    severity = F.when(_c("drivable") & (F.abs("_b._j") > STEP_FAIL), "FAIL").otherwise("WARN")
    return found.select(*_finding("step", severity, _c("_b.o"), "road"))


def road_grades(profile: DataFrame, back: int, step: float) -> DataFrame:
    """Roads (road, drivable, k, s, h) too steep over ``back`` profile points; how bad depends on how much of the length is."""
    w = Window.partitionBy("road").orderBy("k")
    slope = F.abs(F.lead("h", back).over(w) - _c("h")) / F.greatest(F.lead("s", back).over(w) - _c("s"), F.lit(1e-3))
    facts = profile.withColumn("_g", slope).where("_g IS NOT NULL").groupBy("road", "drivable").agg(F.max("_g").alias("_most"), *[(F.sum((_c("_g") > x).cast("int")) * step).alias(n) for n, x in (("_w", GRADE), ("_f", GRADE_FAIL))])
    severity = F.when(_c("drivable") & (_c("_f") >= GRADE_LENGTH_FAIL), "FAIL").when(_c("_w") >= GRADE_LENGTH, "WARN").otherwise("INFO")
    return facts.where(_c("_most") > GRADE).select(*_finding("grade", severity, _c("_most"), "road"))


def road_crossfalls(profile: DataFrame) -> DataFrame:
    """Roads (road, drivable, width, left, right: heights at both sides) whose fall across has a high 90th percentile."""
    fall = F.abs(_c("left") - _c("right")) / _c("width")
    facts = profile.where("width >= 3 AND left IS NOT NULL AND right IS NOT NULL").groupBy("road", "drivable").agg(F.percentile(fall, F.lit(0.9)).alias("_p"))
    return facts.where(_c("_p") > CROSS).select(*_finding("crossfall", F.when(_c("drivable") & (_c("_p") > CROSS_FAIL), "FAIL").otherwise("WARN"), _c("_p"), "road"))


def trees(rows: DataFrame, edges: DataFrame, segments: DataFrame, reach: float, size: float = 8.0) -> DataFrame:
    """Trees (id, x, y, z, scale, h: the terrain there): in a building (by how deep), on a road to drive on (by how far from the axis), above or
    under the terrain, or of no sensible size."""
    inside = J.points_in_polygons(rows, "id", edges.withColumnRenamed("id", "building"), "building", size)
    met = inside.join(rows.select("id", "x", "z"), "id").join(edges.withColumnRenamed("id", "building"), "building")
    deep = met.groupBy("id").agg(F.min(G.segment_distance(_c("x"), _c("z"), _c("x1"), _c("z1"), _c("x2"), _c("z2"))).alias("_d"))
    housed = deep.select(*_finding("tree_inside", F.when(_c("_d") > TREE_INSIDE, "FAIL").otherwise("WARN"), _c("_d")))
    road = road_depths(rows, ["id"], segments, reach).where((_c("depth") > TREE_DEPTH) & _c("drivable"))
    axis = _c("width") / 2 - _c("depth")
    driven = road.select(*_finding("tree_on_road", F.when((axis < TREE_AXIS) & (_c("kind") != "service"), "FAIL").otherwise("WARN"), _c("depth")))
    dy = _c("y") - _c("h")
    height = rows.where(dy.isNotNull() & ~dy.between(*TREE_HEIGHT)).select(*_finding("tree_height", F.when(dy < TREE_SUNK, "FAIL").otherwise("WARN"), F.abs(dy)))
    scale = rows.where("scale <= 0 OR scale > 50").select(*_finding("tree_scale", F.lit("WARN"), _c("scale")))
    return housed.unionByName(driven).unionByName(height).unionByName(scale)


def plants(rows: DataFrame, edges: DataFrame, segments: DataFrame, reach: float, size: float = 8.0) -> DataFrame:
    """check, severity, n and share of all plants (id, x, y, z, h) that stand in a building, on a road, or off the terrain."""
    inside = J.points_in_polygons(rows, "id", edges.withColumnRenamed("id", "building"), "building", size).select("id").distinct().select("id", F.lit("plant_inside").alias("check"))
    road = road_depths(rows, ["id"], segments, reach).where(_c("depth") > PLANT_DEPTH).select("id", F.lit("plant_on_road").alias("check"))
    dy = _c("y") - _c("h")
    off = rows.where(dy.isNotNull() & ~dy.between(*PLANT_HEIGHT)).select("id", F.lit("plant_height").alias("check"))
    total = rows.agg(F.count("*").alias("_all"))
    counted = inside.unionByName(road).unionByName(off).groupBy("check").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    share = _c("n") / _c("_all")
    return counted.select("check", F.when(share > PLANT_SHARE_FAIL, "FAIL").when(share > PLANT_SHARE, "WARN").otherwise("INFO").alias("severity"), "n", share.alias("share"))


def mesh(vertices: DataFrame) -> DataFrame:
    """check, n and share of a mesh's faults, by tile and vertex (tile, v, x y z, nx ny nz, r g b): tiles whose vertices make no whole triangles,
    vertices that aren't finite, triangles without area, normals that aren't of unit length, colours out of 0..1."""
    finite = F.lit(True)
    for name in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b"):
        finite = finite & _c(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf"))
    long = F.sqrt(_c("nx") * _c("nx") + _c("ny") * _c("ny") + _c("nz") * _c("nz"))
    colour = F.greatest("r", "g", "b") > 1.0001
    colour = colour | (F.least("r", "g", "b") < -1e-4)
    per = vertices.agg(F.count("*").alias("_n"), F.sum((~finite).cast("int")).alias("not_finite"), F.sum((finite & (F.abs(long - 1) > NORMAL)).cast("int")).alias("normal"), F.sum((finite & colour).cast("int")).alias("colour"))
    faults = per.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), _c(k).cast("long").alias("n"), (_c(k) / _c("_n")).alias("share")) for k in ("not_finite", "normal", "colour")])).alias("f")).select("f.*")
    odd = vertices.groupBy("tile").agg(F.count("*").alias("_k")).agg(F.sum((_c("_k") % 3 != 0).cast("long")).alias("n"), F.avg((_c("_k") % 3 != 0).cast("double")).alias("share"))
    corners = vertices.withColumns({"_t": F.floor(_c("v") / 3), "_p": F.struct(_c("v").alias("v"), "x", "y", "z")}).groupBy("tile", "_t").agg(F.array_sort(F.collect_list("_p")).alias("_c")).where(F.size("_c") == 3)
    side = lambda k, a: _c("_c")[k][a] - _c("_c")[0][a]
    cross = [side(1, a) * side(2, b) - side(1, b) * side(2, a) for a, b in (("y", "z"), ("z", "x"), ("x", "y"))]
    area = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2
    flat = corners.agg(F.sum((~(area > FLAT_TRIANGLE)).cast("long")).alias("n"), F.avg((~(area > FLAT_TRIANGLE)).cast("double")).alias("share"))
    named = lambda df, check: df.select(F.lit(check).alias("check"), "n", "share")
    out = faults.unionByName(named(odd, "odd_tile")).unionByName(named(flat, "flat_triangle")).where("n > 0")
    failed = _c("check").isin("not_finite", "odd_tile")
    return out.withColumn("severity", F.when(failed, "FAIL").when((_c("check") == "flat_triangle") & (_c("share") <= FLAT_SHARE), "INFO").otherwise("WARN"))


def wall_feet(feet: DataFrame) -> DataFrame:
    """Buildings whose walls' lowest points (id, y, h: the terrain there) hang over the terrain or reach deep under it; the worst point of each."""
    gap = _c("y") - _c("h")
    worst = feet.where((gap > WALL_GAP) | (gap < -WALL_DEEP)).groupBy("id").agg(F.max_by(gap, F.struct(F.abs(gap), gap)).alias("_g"))
    return worst.select(*_finding("wall_foot", F.when(_c("_g") > WALL_GAP_FAIL, "FAIL").otherwise("WARN"), F.abs("_g")))


def roof_tops(buildings: DataFrame, tops: DataFrame) -> DataFrame:
    """Buildings whose highest roof point (id, y) isn't at their ridge."""
    off = F.abs(_c("_top") - _c("ridge"))
    return tops.groupBy("id").agg(F.max("y").alias("_top")).join(buildings, "id").where(off > ROOF_TOP).select(*_finding("roof_top", F.lit("WARN"), off))


def road_clashes(edges: DataFrame, segments: DataFrame, buffers: dict[str, float], least: dict[str, float], step: float = 0.25) -> DataFrame:
    """Buildings to be removed: those of which at least ``least`` square metres lie within ``buffers`` metres of the axes of one kind of road.
    The first such kind by name, its area and the least distance."""
    reach = max(buffers.values())
    near = F.coalesce(*[F.when(_c("kind") == k, F.lit(float(v))) for k, v in buffers.items()])
    points = samples(edges, step).select("id", "x", "z", J._cell("x", reach).alias("_cx"), J._cell("z", reach).alias("_cz"))
    met = points.join(J._segment_cells(segments.where(_c("kind").isin(list(buffers))), reach, reach), ["_cx", "_cz"])
    met = met.withColumn("_d", G.segment_distance(_c("x"), _c("z"), _c("x1"), _c("z1"), _c("x2"), _c("z2"))).where(_c("_d") < near)
    cells = met.groupBy("id", "kind", "x", "z").agg(F.min("_d").alias("_d"))
    need = F.coalesce(*[F.when(_c("kind") == k, F.lit(float(v))) for k, v in least.items()])
    hit = cells.groupBy("id", "kind").agg((F.count("*") * step * step).alias("m2"), F.min("_d").alias("d")).where(_c("m2") >= need)
    return hit.groupBy("id").agg(F.min(F.struct("kind", "m2", "d")).alias("_h")).select("id", "_h.*")
