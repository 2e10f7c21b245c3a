"""Queries: spatial joins on the plane of the embeddings' first two components, and raster algebra on the items' grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions import scalars as S
from terrane.operators import quadtree
from terrane.operators import raster as R
from terrane.operators import spatial as J
from terrane.operators.multipolygons import edges_of_rings
from terrane.plans.registry import Registry
from terrane.plans.statistics import GRID, grid
from terrane.session import table

registry = Registry()
query = registry.query

PLANE = "plane AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS z FROM embeddings)"
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z))"
CENTROIDS = "cent AS (SELECT label, avg(x) AS x, avg(z) AS z FROM plane GROUP BY label)"
#: A polygon a label: its points in the order of their direction from the centre (stars), or of their ids (which cross themselves).
RINGS_SQL = f"""around AS (SELECT p.*, CASE WHEN label % 2 = 0 THEN atan2(p.z - c.z, p.x - c.x) ELSE 0 END AS turn FROM plane p JOIN cent c USING (label)),
rings AS (SELECT label AS poly, vec_id, x, z, row_number() OVER (PARTITION BY label ORDER BY turn, vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM around)"""
EDGES_SQL = f"""{PLANE}, {CENTROIDS}, {RINGS_SQL}, edges AS (SELECT poly, i, x AS x1, z AS z1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(z) OVER w, first(z) OVER w) AS z2, n FROM rings
WINDOW w AS (PARTITION BY poly ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
ROAD = [(-0.3, -0.3), (-0.1, 0.05), (0.1, 0.0), (0.3, 0.25)]
ROAD_EDGES = [(i, *a, *b) for i, (a, b) in enumerate(zip(ROAD, ROAD[1:]))]
ROAD_SQL = "road(seg, x1, z1, x2, z2) AS (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for i, a, b, c, d in ROAD_EDGES) + ")"


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", at(1).alias("x"), at(2).alias("z"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poly, vec_id, x, z, i and n: the points of a polygon a label, stars where it is even, in the order of ids where it is odd."""
    points = plane(spark, sf_dir)
    centre = points.groupBy("label").agg(F.avg("x").alias("_x"), F.avg("z").alias("_z"))
    turn = F.when(F.col("label") % 2 == 0, F.atan2(F.col("z") - F.col("_z"), F.col("x") - F.col("_x"))).otherwise(0.0)
    by = Window.partitionBy("label")
    placed = points.join(centre, "label").withColumns({"i": F.row_number().over(by.orderBy(turn, "vec_id")) - 1, "n": F.count("*").over(by)})
    return placed.select(F.col("label").alias("poly"), "vec_id", "x", "z", "i", "n")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as edges: poly, i, x1 z1 x2 z2, n."""
    return edges_of_rings(rings(spark, sf_dir), ["poly", "n"])


@query(f"WITH {PLANE} SELECT a.vec_id, count(b.vec_id) AS n FROM plane a LEFT JOIN plane b ON a.vec_id <> b.vec_id AND {DIST} <= 0.05 GROUP BY 1")
def q_radius_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.neighbour_counts(plane(spark, sf_dir), "vec_id", 0.05)


@query(f"""WITH {PLANE}, p AS (SELECT a.vec_id, b.vec_id AS other, {DIST} AS d FROM plane a JOIN plane b ON a.vec_id <> b.vec_id AND {DIST} <= 0.08)
SELECT vec_id, other, CAST(r AS INTEGER) AS rank, round(d, 9) AS d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM p) WHERE r <= 4""")
def q_knn4_within_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = plane(spark, sf_dir).select("vec_id", "x", "z")
    pairs = J.within_radius(points, points.withColumnRenamed("vec_id", "other"), 0.08).where("vec_id <> other")
    order = Window.partitionBy("vec_id").orderBy("d", "other")
    return pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 4").select("vec_id", "other", "rank", F.round("d", 9).alias("d"))


@query(f"""WITH {PLANE}, {CENTROIDS}, p AS (SELECT a.vec_id, b.label AS near, {DIST} AS d FROM plane a, cent b)
SELECT vec_id, near, round(d, 7) AS d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, near) AS r FROM p) WHERE r = 1""")
def q_nearest_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = plane(spark, sf_dir)
    centroids = points.groupBy(F.col("label").alias("near")).agg(F.avg("x").alias("x"), F.avg("z").alias("z"))
    return quadtree.nearest(points, "vec_id", centroids, "near").select("vec_id", "near", F.round("d", 7).alias("d"))


@query(f"""WITH {PLANE}, p AS (SELECT a.vec_id, b.vec_id AS other, {DIST} AS d FROM plane a JOIN plane b ON a.vec_id <> b.vec_id)
SELECT vec_id, other, CAST(r AS INTEGER) AS rank, round(d, 9) AS d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM p) WHERE r <= 4""")
def q_knn4(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = plane(spark, sf_dir)
    return quadtree.nearest(points, "vec_id", points.withColumnRenamed("vec_id", "other"), "other", 4, apart=True).withColumn("d", F.round("d", 9))


@query(f"""WITH {PLANE}, b AS (SELECT label, vec_id % 5 AS part, min(x) x0, max(x) x1, min(z) z0, max(z) z1 FROM plane GROUP BY 1, 2), k AS (SELECT *, label * 5 + part AS id FROM b)
SELECT p.id AS a, q.id AS b, round((least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.z1, q.z1) - greatest(p.z0, q.z0)), 9) AS area
FROM k p JOIN k q ON p.id < q.id AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.z0 < q.z1 AND q.z0 < p.z1""")
def q_bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = plane(spark, sf_dir).groupBy((F.col("label") * 5 + F.col("vec_id") % 5).alias("id"))
    boxes = groups.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    return J.overlapping_boxes(boxes, "id", 0.1).select("a", "b", F.round("area", 9).alias("area"))


@query(f"""WITH {EDGES_SQL} SELECT vec_id, poly FROM plane, edges WHERE (z1 > z) <> (z2 > z) AND x < (x2 - x1) * (z - z1) / (z2 - z1) + x1 GROUP BY vec_id, poly HAVING count(*) % 2 = 1""")
def q_point_in_box_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.points_in_polygons(plane(spark, sf_dir), "vec_id", edges(spark, sf_dir), "poly", 0.05)


@query(f"""WITH {PLANE}, {ROAD_SQL}, t AS (SELECT vec_id, seg, x, z, x1, z1, x2, z2, least(greatest(((x-x1)*(x2-x1)+(z-z1)*(z2-z1))/((x2-x1)*(x2-x1)+(z2-z1)*(z2-z1)), 0), 1) AS t FROM plane, road),
d AS (SELECT vec_id, seg, sqrt((x-(x1+t*(x2-x1)))*(x-(x1+t*(x2-x1)))+(z-(z1+t*(z2-z1)))*(z-(z1+t*(z2-z1)))) AS d FROM t)
SELECT vec_id, seg, round(d, 9) AS d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, seg) AS r FROM d WHERE d <= 0.08) WHERE r = 1""")
def q_nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    road = spark.createDataFrame(ROAD_EDGES, "seg int, x1 double, z1 double, x2 double, z2 double")
    return J.nearest_segment(plane(spark, sf_dir), "vec_id", road, "seg", 0.08).select("vec_id", "seg", F.round("d", 9).alias("d"))


@query(f"""WITH {EDGES_SQL}, c AS (SELECT a.poly, a.i, b.i AS j, (a.x2-a.x1)*(b.z1-a.z1)-(a.z2-a.z1)*(b.x1-a.x1) AS o1, (a.x2-a.x1)*(b.z2-a.z1)-(a.z2-a.z1)*(b.x2-a.x1) AS o2,
  (b.x2-b.x1)*(a.z1-b.z1)-(b.z2-b.z1)*(a.x1-b.x1) AS o3, (b.x2-b.x1)*(a.z2-b.z1)-(b.z2-b.z1)*(a.x2-b.x1) AS o4
  FROM edges a JOIN edges b ON a.poly = b.poly AND a.i + 2 <= b.i AND NOT (a.i = 0 AND b.i = a.n - 1)) SELECT poly, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM c WHERE o1 * o2 < 0 AND o3 * o4 < 0""")
def q_self_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.self_crossings(edges(spark, sf_dir), "poly", "i", "n", 0.05)


@query(f"WITH {EDGES_SQL} SELECT poly, round(sum(x1 * z2 - x2 * z1) / 2, 9) AS area FROM edges GROUP BY 1")
def q_shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.transform(F.array_sort(F.collect_list(F.struct("i", "x1", "z1"))), lambda p: F.struct(p["x1"].alias("x"), p["z1"].alias("z")))
    return edges(spark, sf_dir).groupBy("poly").agg(points.alias("ring")).select("poly", F.round(G.ring_area(F.col("ring")), 9).alias("area"))


@query(f"""WITH {EDGES_SQL}, d AS (SELECT *, CAST(greatest(ceil(sqrt((x1-x2)*(x1-x2)+(z1-z2)*(z1-z2)) / 0.03), 1) AS INTEGER) AS parts FROM edges)
SELECT poly, CAST(i AS INTEGER) AS i, CAST(k AS INTEGER) AS k, round(x1 + (x2 - x1) * (k / parts::DOUBLE), 9) AS x, round(z1 + (z2 - z1) * (k / parts::DOUBLE), 9) AS z FROM d, unnest(range(0, parts)) AS u(k)""")
def q_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.densified(edges(spark, sf_dir), 0.03).select("poly", "i", "k", F.round("x", 9).alias("x"), F.round("z", 9).alias("z"))


@query(f"""WITH {EDGES_SQL}, pts AS (SELECT vec_id // 25 AS line, vec_id % 25 AS i, vec_id, x * 1.5::DOUBLE AS x, z * 1.5::DOUBLE AS z FROM plane), star AS (SELECT * FROM edges WHERE poly % 4 = 0),
ins AS (SELECT poly, vec_id FROM pts, star WHERE (z1 > z) <> (z2 > z) AND x < (x2 - x1) * (z - z1) / (z2 - z1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1),
t AS (SELECT *, least(greatest(((x-x1)*(x2-x1)+(z-z1)*(z2-z1))/((x2-x1)*(x2-x1)+(z2-z1)*(z2-z1)), 0), 1) AS t FROM pts, star),
nr AS (SELECT DISTINCT poly, vec_id FROM t WHERE sqrt((x-(x1+t*(x2-x1)))*(x-(x1+t*(x2-x1)))+(z-(z1+t*(z2-z1)))*(z-(z1+t*(z2-z1)))) <= 0.01),
sg AS (SELECT * FROM (SELECT *, lead(vec_id) OVER w AS vb, lead(x) OVER w AS xb, lead(z) OVER w AS zb FROM pts WINDOW w AS (PARTITION BY line ORDER BY i)) WHERE vb IS NOT NULL),
o AS (SELECT poly, vec_id, vb, (xb-x)*(z1-z)-(zb-z)*(x1-x) AS o1, (xb-x)*(z2-z)-(zb-z)*(x2-x) AS o2, (x2-x1)*(z-z1)-(z2-z1)*(x-x1) AS o3, (x2-x1)*(zb-z1)-(z2-z1)*(xb-x1) AS o4 FROM sg, star),
h AS (SELECT DISTINCT poly, vec_id, vb FROM o WHERE o1 * o2 <= 0 AND o3 * o4 <= 0),
k AS (SELECT * FROM ins UNION SELECT * FROM nr UNION SELECT poly, vec_id FROM h UNION SELECT poly, vb FROM h),
g AS (SELECT k.poly, p.*, p.i - row_number() OVER (PARTITION BY k.poly, line ORDER BY i) AS g FROM k JOIN pts p USING (vec_id)), r AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY poly, line, g) AS n FROM g) WHERE n >= 2)
SELECT poly, line, CAST(dense_rank() OVER (PARTITION BY poly, line ORDER BY g) - 1 AS INTEGER) AS run, i, round(x, 9) AS x, round(z, 9) AS z FROM r""")
def q_clip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = plane(spark, sf_dir).select(F.floor(F.col("vec_id") / 25).alias("line"), (F.col("vec_id") % 25).alias("i"), (F.col("x") * 1.5).alias("x"), (F.col("z") * 1.5).alias("z"))
    clipped = J.clipped_lines(points, "line", edges(spark, sf_dir).where("poly % 4 = 0").drop("i", "n"), "poly", 0.01, 0.05)
    return clipped.select("poly", "line", "run", "i", F.round("x", 9).alias("x"), F.round("z", 9).alias("z"))


@query(f"""WITH {PLANE}, {GRID}, p AS (SELECT vec_id, (x + 0.5) * 60 AS gx, (z + 0.5) * 60 AS gz FROM plane), b AS (SELECT *, CAST(floor(gx) AS INTEGER) AS bx, CAST(floor(gz) AS INTEGER) AS bz FROM p)
SELECT vec_id, round(sum((CASE WHEN g.ix = bx THEN 1 - (gx - bx) ELSE gx - bx END) * (CASE WHEN g.iz = bz THEN 1 - (gz - bz) ELSE gz - bz END) * v), 5) AS v
FROM b JOIN grid g ON g.ix IN (bx, bx + 1) AND g.iz IN (bz, bz + 1) GROUP BY vec_id HAVING count(*) = 4""")
def q_cell_gather_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = plane(spark, sf_dir).select("vec_id", ((F.col("x") + 0.5) * 60).alias("gx"), ((F.col("z") + 0.5) * 60).alias("gz"))
    return R.bilinear(scaled, "vec_id", grid(spark, sf_dir), "gx", "gz", "v", "v").select("vec_id", F.round("v", 5).alias("v"))


@query(f"WITH {GRID} SELECT a.ix, a.iz, sum(b.v) AS s FROM grid a JOIN grid b ON b.ix BETWEEN a.ix - 2 AND a.ix + 2 AND b.iz BETWEEN a.iz - 2 AND a.iz + 2 GROUP BY 1, 2")
def q_box_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.box_sum(grid(spark, sf_dir), "v", 2, "s").select("ix", "iz", "s")


@query(f"""WITH {GRID}, o AS (SELECT CAST(dx AS INTEGER) AS dx, CAST(dz AS INTEGER) AS dz FROM range(-1, 2) a(dx), range(-1, 2) b(dz)), bounds AS (SELECT max(ix) AS hx, max(iz) AS hz FROM grid)
SELECT a.ix, a.iz, round(sum(b.v) / 9, 6) AS m FROM grid a CROSS JOIN o CROSS JOIN bounds JOIN grid b ON b.ix = least(greatest(a.ix + dx, 0), hx) AND b.iz = least(greatest(a.iz + dz, 0), hz) GROUP BY 1, 2""")
def q_box_mean_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.box_mean_clamped(grid(spark, sf_dir), "v", 1, "m").select("ix", "iz", F.round("m", 6).alias("m"))


@query(f"WITH {GRID} SELECT a.ix, a.iz, round(any_value(a.v) - avg(b.v), 6) AS tpi FROM grid a JOIN grid b ON b.ix BETWEEN a.ix - 5 AND a.ix + 5 AND b.iz BETWEEN a.iz - 5 AND a.iz + 5 GROUP BY 1, 2")
def q_tpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relative_height(grid(spark, sf_dir), "v", 5).select("ix", "iz", F.round("tpi", 6).alias("tpi"))


@query(f"""WITH {GRID}, g AS (SELECT ix, iz, v, lag(v) OVER r AS l, lead(v) OVER r AS rr, lag(v) OVER c AS u, lead(v) OVER c AS d FROM grid WINDOW r AS (PARTITION BY iz ORDER BY ix), c AS (PARTITION BY ix ORDER BY iz)),
s AS (SELECT ix, iz, CASE WHEN l IS NULL THEN rr - v WHEN rr IS NULL THEN v - l ELSE (rr - l) / 2 END / 10 AS gx, CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END / 10 AS gz FROM g)
SELECT ix, iz, round(gx, 6) AS gx, round(gz, 6) AS gz, round(degrees(atan(sqrt(gx * gx + gz * gz))), 6) AS slope FROM s""")
def q_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.gradient(grid(spark, sf_dir), "v", 10.0)
    return out.select("ix", "iz", F.round("gx", 6).alias("gx"), F.round("gz", 6).alias("gz"), F.round("slope", 6).alias("slope"))


@query(f"""WITH {GRID}, g AS (SELECT ix, iz, lag(v) OVER r + lead(v) OVER r + lag(v) OVER c + lead(v) OVER c - 4 * v AS lap FROM grid WINDOW r AS (PARTITION BY iz ORDER BY ix), c AS (PARTITION BY ix ORDER BY iz))
SELECT ix, iz, lap FROM g WHERE abs(lap) > 300""")
def q_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.laplacian(grid(spark, sf_dir), "v").where("abs(lap) > 300").select("ix", "iz", "lap")


@query(f"WITH {GRID} SELECT a.ix, a.iz, any_value(a.v) AS v FROM grid a JOIN grid b ON b.ix BETWEEN a.ix - 1 AND a.ix + 1 AND b.iz BETWEEN a.iz - 1 AND a.iz + 1 GROUP BY 1, 2 HAVING any_value(a.v) >= max(b.v)")
def q_localmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.local_maxima(grid(spark, sf_dir), "v").select("ix", "iz", "v")


@query(f"""WITH {GRID}, m AS (SELECT ix, iz FROM grid WHERE v > 600), o AS (SELECT dx, dz FROM range(-2, 3) a(dx), range(-2, 3) b(dz) WHERE dx * dx + dz * dz <= 5),
d AS (SELECT DISTINCT CAST(ix + dx AS INTEGER) AS ix, CAST(iz + dz AS INTEGER) AS iz FROM m, o) SELECT ix, iz FROM d WHERE (ix, iz) IN (SELECT (ix, iz) FROM grid) AND (ix, iz) NOT IN (SELECT (ix, iz) FROM m)""")
def q_dilate_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    mask = cells.where("v > 600").select("ix", "iz")
    return R.dilated(mask, 2, cells).join(mask, ["ix", "iz"], "left_anti")


@query(f"""WITH {GRID}, m AS (SELECT ix, iz FROM grid WHERE v > 250), rest AS (SELECT ix, iz FROM grid WHERE NOT v > 250), o AS (SELECT dx, dz FROM range(-1, 2) a(dx), range(-1, 2) b(dz) WHERE dx * dx + dz * dz <= 2),
e AS (SELECT ix, iz FROM m WHERE NOT EXISTS (SELECT 1 FROM rest, o WHERE m.ix = rest.ix + dx AND m.iz = rest.iz + dz)), d AS (SELECT DISTINCT CAST(ix + dx AS INTEGER) AS ix, CAST(iz + dz AS INTEGER) AS iz FROM e, o)
SELECT ix, iz FROM d WHERE (ix, iz) IN (SELECT (ix, iz) FROM grid)""")
def q_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return R.opened(cells.where("v > 250").select("ix", "iz"), 1, cells)


@query(f"WITH {GRID} SELECT CAST(ix // 5 AS INTEGER) AS ix, CAST(iz // 5 AS INTEGER) AS iz, round(avg(v), 6) AS mean FROM grid WHERE ix < 60 AND iz < 60 GROUP BY 1, 2")
def q_block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.block_mean(grid(spark, sf_dir), "v", 5, 64, 64).select("ix", "iz", F.round("mean", 6).alias("mean"))


@query(f"WITH {GRID} SELECT ix, iz, CASE WHEN ix % 7 = 0 THEN 'track' WHEN v > 600 THEN 'forest' WHEN v < 100 THEN 'meadow' ELSE 'base' END AS cls FROM grid")
def q_priority_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    layer = lambda condition, name: cells.where(condition).select("ix", "iz", F.lit(name).alias("cls"))
    return R.overlaid([layer("true", "base"), layer("v < 100", "meadow"), layer("v > 600", "forest"), layer("ix % 7 = 0", "track")], "cls")


@query(f"WITH {GRID}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM grid) SELECT ix, iz, CAST(CASE WHEN hi > lo THEN round_even((v - lo) / ((hi - lo) / 255), 0) ELSE 0 END AS INTEGER) AS code FROM grid, b")
def q_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    bounds = cells.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    return cells.crossJoin(F.broadcast(bounds)).select("ix", "iz", S.quantise(F.col("v"), F.col("lo"), F.col("hi")).alias("code"))


@query(f"""WITH {GRID}, z AS (SELECT ix, iz, 1 AS zone FROM grid WHERE ix < 20 UNION ALL SELECT ix, iz, 2 FROM grid WHERE iz > 40)
SELECT zone, round(median(v), 4) AS median, min(v) AS least, count(*) AS n FROM z JOIN grid USING (ix, iz) GROUP BY 1""")
def q_zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    zones = cells.where("ix < 20").select("ix", "iz", F.lit(1).alias("zone")).unionByName(cells.where("iz > 40").select("ix", "iz", F.lit(2).alias("zone")))
    return R.zonal(cells, zones, "zone", [F.round(F.percentile("v", F.lit(0.5)), 4).alias("median"), F.min("v").alias("least"), F.count("*").alias("n")])


@query(f"""WITH {GRID}, o(k, dx, dz) AS (VALUES (0,-1,-1),(1,0,-1),(2,1,-1),(3,-1,0),(4,1,0),(5,-1,1),(6,0,1),(7,1,1)),
d AS (SELECT a.ix, a.iz, k, b.ix AS tx, b.iz AS tz, (a.v - b.v) / sqrt(CAST(dx * dx + dz * dz AS DOUBLE)) AS d FROM grid a CROSS JOIN o JOIN grid b ON b.ix = a.ix + dx AND b.iz = a.iz + dz),
r AS (SELECT *, row_number() OVER (PARTITION BY ix, iz ORDER BY d DESC, k) AS r FROM d WHERE d > 0) SELECT g.ix, g.iz, coalesce(tx, -1) AS tx, coalesce(tz, -1) AS tz FROM grid g LEFT JOIN (SELECT * FROM r WHERE r = 1) r ON g.ix = r.ix AND g.iz = r.iz""")
def q_flow_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.steepest_descent(grid(spark, sf_dir), "v").select("ix", "iz", F.coalesce("tx", F.lit(-1)).alias("tx"), F.coalesce("tz", F.lit(-1)).alias("tz"))
