"""Queries: ordered folds and geometry that goes beyond single expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions import scalars as S
from terrane.operators import folds as M
from terrane.plans.registry import Registry
from terrane.operators import multipolygons as P
from terrane.plans.space import CENTROIDS, EDGES_SQL, PLANE, edges, plane, rings
from terrane.session import table

registry = Registry()
query = registry.query

_SHARE = 1 - math.exp(-1.0 / 3.0)
_DAILY = "d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d')) AS n FROM events GROUP BY 1, 2)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("v"))


@query(f"WITH RECURSIVE {_DAILY}, s AS (SELECT user_id, day, n, 50 + (v - 50) * {_SHARE}::DOUBLE AS x FROM d WHERE n = 1 UNION ALL SELECT d.user_id, d.day, d.n, x + (v - x) * {_SHARE}::DOUBLE FROM s JOIN d ON d.user_id = s.user_id AND d.n = s.n + 1) SELECT user_id, day, round(x, 5) AS smooth FROM s")
def q_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.smoothed(_daily(spark, sf_dir), "user_id", "day", "v", 50.0, 1.0, 3.0).select("user_id", "day", F.round("smooth", 5).alias("smooth"))


@query(f"WITH RECURSIVE {_DAILY}, s AS (SELECT user_id, day, n, v * 0.75::DOUBLE AS store, v / 4 AS outflow FROM d WHERE n = 1 UNION ALL SELECT d.user_id, d.day, d.n, (store + v) * 0.75::DOUBLE, (store + v) / 4 FROM s JOIN d ON d.user_id = s.user_id AND d.n = s.n + 1) SELECT user_id, day, round(outflow + 1e-8, 5) AS outflow FROM s")
def q_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.reservoir(_daily(spark, sf_dir), "user_id", "day", "v", 4.0).select("user_id", "day", F.round(F.col("outflow") + 1e-8, 5).alias("outflow"))


@query(f"WITH RECURSIVE {_DAILY}, s AS (SELECT user_id, day, n, least(greatest((50 - v) / 40, 0), 1) AS frost FROM d WHERE n = 1 UNION ALL SELECT d.user_id, d.day, d.n, least(greatest(frost + (50 - v) / 40, 0), 1) FROM s JOIN d ON d.user_id = s.user_id AND d.n = s.n + 1) SELECT user_id, day, round(frost + 1e-8, 5) AS frost FROM s")
def q_frost_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _daily(spark, sf_dir).select("user_id", "day", ((50 - F.col("v")) / 40).alias("c"))
    return M.bounded_state(changes, "user_id", "day", "c", name="frost").select("user_id", "day", F.round(F.col("frost") + 1e-8, 5).alias("frost"))


@query(f"""WITH RECURSIVE {_DAILY}, w AS (SELECT user_id, day, n, greatest(v - 30, 0) AS rain, {25400.0 / 75.0 - 254.0}::DOUBLE AS s FROM d),
r AS (SELECT *, CASE WHEN rain <= 0.2::DOUBLE * s THEN 0 ELSE pow(rain - 0.2::DOUBLE * s, 2) / (rain + 0.8::DOUBLE * s) END AS runoff FROM w),
f(user_id, day, n, runoff, evaporated, drained, store) AS (SELECT DISTINCT user_id, '', 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 50.0::DOUBLE FROM d UNION ALL
  SELECT user_id, day, n, runoff, e, greatest(0, b - e - 100), b - e - greatest(0, b - e - 100) FROM (SELECT *, least(b, 4.0::DOUBLE * least(1, b / 100)) AS e FROM
    (SELECT r.user_id, r.day, r.n, r.runoff, f.store + (r.rain - r.runoff) AS b FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)))
SELECT user_id, day, round(runoff + 1e-8, 5) AS runoff, round(evaporated + 1e-8, 5) AS evaporated, round(drained + 1e-8, 5) AS drained, round(store + 1e-8, 5) AS store FROM f WHERE n > 0""")
def q_soil_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    water = _daily(spark, sf_dir).select("user_id", "day", F.greatest(F.col("v") - 30, F.lit(0.0)).alias("rain"), F.lit(4.0).alias("pet"))
    return M.soil_bucket(water, "user_id", "day").select("user_id", "day", *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("runoff", "evaporated", "drained", "store")])


@query(f"""WITH RECURSIVE {_DAILY}, w AS (SELECT user_id, day, n, v / 3 AS t, v / 100 AS w FROM d),
f(user_id, day, n, total, dry, alive) AS (SELECT DISTINCT user_id, '', 0::BIGINT, 0.0::DOUBLE, 0, true FROM d UNION ALL
  SELECT user_id, day, n, total, dry, alive AND t > -2 AND dry < 6 FROM (SELECT w.user_id, w.day, w.n, w.t, f.alive, CASE WHEN f.alive THEN f.total + greatest(0, w.t - 5) ELSE f.total END AS total,
    CASE WHEN NOT f.alive THEN f.dry WHEN w.w < 0.2::DOUBLE THEN f.dry + 1 ELSE 0 END AS dry FROM f JOIN w ON w.user_id = f.user_id AND w.n = f.n + 1))
SELECT user_id, day, CAST(CASE WHEN NOT alive THEN -1 ELSE (total >= 50)::INT + (total >= 120)::INT + (total >= 200)::INT + (total >= 300)::INT END AS INTEGER) AS stage FROM f WHERE n > 0""")
def q_crop_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _daily(spark, sf_dir).select("user_id", "day", (F.col("v") / 3).alias("t"), (F.col("v") / 100).alias("w"))
    return M.crop_stages(days, "user_id", "day", 5.0, (50.0, 120.0, 200.0, 300.0), -2.0, 6)


@query("""WITH RECURSIVE p(area, day, n, taken) AS (SELECT n_nationkey, 0, (n_nationkey + 5)::DOUBLE, 0.0::DOUBLE FROM nation UNION ALL
  SELECT area, day, m - t, t FROM (SELECT area, day, m, CASE WHEN day % 30 = 0 THEN greatest(0, m - 0.6::DOUBLE * 100.0::DOUBLE) ELSE 0 END AS t FROM
    (SELECT area, day + 1 AS day, n + (0.05::DOUBLE * n * (1 - n / 100.0::DOUBLE) - 0.01::DOUBLE * n) AS m FROM p WHERE day < 120)))
SELECT area, day, round(n + 1e-8, 5) AS n, round(taken + 1e-8, 5) AS taken FROM p WHERE day > 0""")
def q_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), (F.col("n_nationkey") + 5).cast("double").alias("start"), F.lit(100.0).alias("capacity"))
    return M.populations(areas, 120, 0.05, 0.01, 0.6).select("area", "day", F.round(F.col("n") + 1e-8, 5).alias("n"), F.round(F.col("taken") + 1e-8, 5).alias("taken"))


@query(f"""WITH RECURSIVE c(station, hour, state) AS (SELECT n_nationkey, -1, 'clear' FROM nation UNION ALL
  SELECT station, hour + 1, CASE state WHEN 'clear' THEN CASE WHEN x < 6 THEN 'clear' WHEN x < 9 THEN 'cloudy' ELSE 'rain' END WHEN 'cloudy' THEN CASE WHEN x < 2 THEN 'clear' WHEN x < 7 THEN 'cloudy' ELSE 'rain' END
    ELSE CASE WHEN x < 1 THEN 'clear' WHEN x < 6 THEN 'cloudy' ELSE 'rain' END END FROM (SELECT *, 10 * {S.hash01_sql("station", "(hour + 1)", seed=11)} AS x FROM c WHERE hour < 71))
SELECT station, hour, state FROM c WHERE hour >= 0""")
def q_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"clear": {"clear": 6, "cloudy": 3, "rain": 1}, "cloudy": {"clear": 2, "cloudy": 5, "rain": 3}, "rain": {"cloudy": 5, "rain": 4, "clear": 1}}
    return M.weather_chain(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("station")), 72, weights, "clear")


HULL_SQL = f"""{PLANE}, e AS (SELECT a.label, a.vec_id AS p, b.vec_id AS q, a.x AS ax, a.z AS az FROM plane a JOIN plane b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE NOT EXISTS (SELECT 1 FROM plane c WHERE c.label = a.label AND c.vec_id <> a.vec_id AND c.vec_id <> b.vec_id AND (b.x - a.x) * (c.z - a.z) - (b.z - a.z) * (c.x - a.x) < 0))"""


@query(f"WITH {HULL_SQL} SELECT DISTINCT label, round(ax, 9) AS x, round(az, 9) AS z FROM e")
def q_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hulls(plane(spark, sf_dir), "label").select("label", F.round("x", 9).alias("x"), F.round("z", 9).alias("z"))


@query(f"""WITH {HULL_SQL.replace("a.z AS az", "a.z AS az, b.x AS bx, b.z AS bz")}, t AS (SELECT DISTINCT label, atan2(bz - az, bx - ax) AS r FROM e), u AS (SELECT DISTINCT label, round(r - floor(r / (pi() / 2)) * (pi() / 2), 12) AS t FROM t),
g AS (SELECT u.label, t, min(cos(t) * x + sin(t) * z) AS x0, max(cos(t) * x + sin(t) * z) AS x1, min(cos(t) * z - sin(t) * x) AS z0, max(cos(t) * z - sin(t) * x) AS z1 FROM u JOIN plane p ON p.label = u.label GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (x1 - x0) * (z1 - z0), t) AS r FROM g)
SELECT label, round(cos(t) * (x0 + x1) / 2 - sin(t) * (z0 + z1) / 2, 6) AS cx, round(sin(t) * (x0 + x1) / 2 + cos(t) * (z0 + z1) / 2, 6) AS cz, round(greatest(x1 - x0, z1 - z0), 6) AS length,
  round(least(x1 - x0, z1 - z0), 6) AS width, round(degrees(CASE WHEN x1 - x0 >= z1 - z0 THEN t ELSE t + pi() / 2 END) % 180, 6) AS angle FROM b WHERE r = 1""")
def q_tightest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = M.tightest_boxes(M.hulls(plane(spark, sf_dir), "label"), "label")
    return boxes.select("label", *[F.round(c, 6).alias(c) for c in ("cx", "cz", "length", "width", "angle")])


# Rings are cut into ways of three edges, every other one backwards, numbered from their middle; label 3's ring is left open.
@query(f"""WITH {EDGES_SQL}, w AS (SELECT *, (i // 3 + (n + 2) // 6) % ((n + 2) // 3) AS way FROM rings), s AS (SELECT poly, min(i) AS begin, way FROM w GROUP BY poly, way),
z AS (SELECT poly, begin FROM s WHERE way = 0), o AS (SELECT w.*, begin, (w.i - begin + n) % n AS forward, least(n - begin, 3) AS first FROM rings w JOIN z USING (poly))
SELECT poly, 0 AS ring, CAST(CASE WHEN (begin // 3) % 2 = 0 THEN forward ELSE (first - forward + n) % n END AS INTEGER) AS i, vec_id AS node FROM o WHERE poly <> 3""")
def q_ring_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = rings(spark, sf_dir)
    part, parts = F.expr("i div 3"), F.expr("(n + 2) div 3")
    own = points.select("poly", "n", "vec_id", "i", part.alias("part"), parts.alias("parts"))
    ends = own.where("i % 3 = 0").select("poly", "n", "vec_id", F.expr("CASE WHEN i = 0 THEN n ELSE i END AS i"), F.expr("CASE WHEN i = 0 THEN parts - 1 ELSE part - 1 END AS part"), "parts")
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("i", "vec_id"))), lambda p: p["vec_id"])
    ways = own.unionByName(ends).groupBy("poly", "part", "parts").agg(nodes.alias("nodes")).where("poly <> 3 OR part <> 2")
    ways = ways.select("poly", F.expr("(part + (parts div 2)) % parts AS way"), F.when(F.col("part") % 2 == 1, F.reverse("nodes")).otherwise(F.col("nodes")).alias("nodes"))
    return P.stitched(ways, ["poly"]).select("poly", "ring", "i", "node")


# Half as large, each ring is a hole of its own ring and of others.
@query(f"""WITH {EDGES_SQL}, a AS (SELECT poly, abs(sum(x1 * z2 - x2 * z1)) AS area FROM edges GROUP BY poly), v AS (SELECT r.poly AS ring, c.x + (r.x - c.x) * 0.5 AS x, c.z + (r.z - c.z) * 0.5 AS z FROM rings r JOIN cent c ON c.label = r.poly WHERE i = 0),
h AS (SELECT ring, e.poly FROM v JOIN edges e ON (z1 > z) <> (z2 > z) AND x < (x2 - x1) * (z - z1) / (z2 - z1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT 1 AS relation, ring, arg_min(poly, row(area, poly)) AS around FROM h JOIN a USING (poly) GROUP BY ring""")
def q_ring_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = rings(spark, sf_dir).select(F.lit(1).alias("relation"), F.col("poly").alias("ring"), "i", "x", "z")
    centre = plane(spark, sf_dir).groupBy(F.col("label").alias("ring")).agg(F.avg("x").alias("_x"), F.avg("z").alias("_z"))
    half = lambda c: (F.col(f"_{c}") + (F.col(c) - F.col(f"_{c}")) * 0.5).alias(c)
    inner = outer.join(centre, "ring").select("relation", "ring", "i", half("x"), half("z"))
    return P.nested(inner, outer, "relation", 0.05).select("relation", "ring", "around")


def _spread_sql(turns: int) -> str:
    square = "(p.x - {t}.x) * (p.x - {t}.x) + (p.z - {t}.z) * (p.z - {t}.z)"
    first = f"SELECT label, vec_id, x, z FROM (SELECT p.*, row_number() OVER (PARTITION BY p.label ORDER BY {square.format(t='c')}, vec_id) AS r FROM plane p JOIN cent c ON c.label = p.label) WHERE r = 1"
    parts = [f"t0 AS ({first})"]
    for k in range(1, turns):
        far = ", ".join(square.format(t=f"t{i}") for i in range(k))
        joins = " ".join(f"JOIN t{i} ON t{i}.label = p.label" for i in range(k))
        parts.append(f"t{k} AS (SELECT label, vec_id, x, z FROM (SELECT p.*, row_number() OVER (PARTITION BY p.label ORDER BY least({far}) DESC, p.vec_id) AS r FROM plane p {joins}) WHERE r = 1)")
    return f"WITH {PLANE}, {CENTROIDS}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT label, {k} AS turn, vec_id FROM t{k}" for k in range(turns))


@query(_spread_sql(4))
def q_farthest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.spread_choice(plane(spark, sf_dir), "label", "vec_id", 4)


_WINDOW = [(-0.15, -0.15, 0.15, -0.15), (0.15, -0.15, 0.15, 0.15), (0.15, 0.15, -0.15, 0.15), (-0.15, 0.15, -0.15, -0.15)]


def _clip_sql() -> str:
    parts = [f"{EDGES_SQL}, r0 AS (SELECT poly, i::BIGINT AS i, x1 AS x, z1 AS z FROM edges WHERE poly <> 3)"]
    for k, (x1, z1, x2, z2) in enumerate(_WINDOW):
        side = f"({x2 - x1!r}::DOUBLE * (z - {z1}::DOUBLE) - {z2 - z1!r}::DOUBLE * (x - {x1}::DOUBLE))"
        nxt = lambda c: f"coalesce(lead({c}) OVER w, first({c}) OVER w)"
        parts.append(f"s{k} AS (SELECT *, {side} AS s FROM r{k}), n{k} AS (SELECT *, {nxt('x')} AS nx, {nxt('z')} AS nz, {nxt('s')} AS t FROM s{k} WINDOW w AS (PARTITION BY poly ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")
        kept = f"SELECT poly, 2 * i AS o, x, z FROM n{k} WHERE s >= 0 UNION ALL SELECT poly, 2 * i + 1, x + s / (s - t) * (nx - x), z + s / (s - t) * (nz - z) FROM n{k} WHERE s * t < 0"
        parts.append(f"r{k + 1} AS (SELECT poly, row_number() OVER (PARTITION BY poly ORDER BY o) - 1 AS i, x, z FROM ({kept}))")
    return f"WITH {', '.join(parts)} SELECT poly, i::INTEGER AS i, round(x, 9) AS x, round(z, 9) AS z FROM r{len(_WINDOW)}"


@query(_clip_sql())
def q_clip_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = edges(spark, sf_dir).where("poly <> 3").select("poly", "i", F.col("x1").alias("x"), F.col("z1").alias("z"))
    return M.clipped(rings, "poly", _WINDOW).select("poly", "i", F.round("x", 9).alias("x"), F.round("z", 9).alias("z"))


@query(f"""WITH p AS (SELECT n_nationkey, radians(40 + n_nationkey / 5.0::DOUBLE) AS lat, radians(n_nationkey / 4.0::DOUBLE - 2) AS d, radians(45.0::DOUBLE) AS p0 FROM nation),
c AS (SELECT *, acos(least(greatest(sin(p0) * sin(lat) + cos(p0) * cos(lat) * cos(d), -1), 1)) AS c FROM p), k AS (SELECT *, {G.EARTH_RADIUS}::DOUBLE * CASE WHEN abs(sin(c)) < 1e-12 THEN 1 ELSE c / sin(c) END AS k FROM c)
SELECT n_nationkey, round(k * cos(lat) * sin(d), 3) AS x, round(k * (cos(p0) * sin(lat) - sin(p0) * cos(lat) * cos(d)), 3) AS z FROM k""")
def q_azimuthal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = 40 + F.col("n_nationkey") / 5.0, F.col("n_nationkey") / 4.0 - 2
    x, z = G.azimuthal(lat, lon, 45.0, 0.0)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(x, 3).alias("x"), F.round(z, 3).alias("z"))


@query("""SELECT p_partkey, round(CASE WHEN c / 255.0::DOUBLE <= 0.04045 THEN c / 255.0::DOUBLE / 12.92 ELSE pow((c / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END, 9) AS linear,
  round(t * t * (3 - 2 * t), 9) AS step FROM (SELECT p_partkey, p_size * 5 AS c, least(greatest((p_size - 10) / 30.0::DOUBLE, 0), 1) AS t FROM part)""")
def q_scalar_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.srgb_to_linear(size * 5), 9).alias("linear"), F.round(S.smoothstep(10.0, 40.0, size), 9).alias("step"))
