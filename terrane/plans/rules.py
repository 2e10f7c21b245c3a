"""Queries: rules on a town whose buildings, doors, trees and things derive from the suppliers and whose terrain is the items' grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import raster as R
from terrane.operators import site_rules as B
from terrane.plans.registry import Registry
from terrane.plans.statistics import GRID, grid
from terrane.session import table

registry = Registry()
query = registry.query

_D = "CAST({} AS DOUBLE)".format
#: Columns of the buildings as expressions that Spark and DuckDB read alike, in three steps; two neighbours lie up to eight metres apart.
_PLACE = {"cx": _D("8 + (floor(id / 2) * 74) % 112 + (id % 2) * (floor(id / 2) % 5) * 2 + 200 * floor((id - 1) / 100)"), "cz": _D("8 + (floor(id / 2) * 53) % 109"), "a": f"{_D('20 + (id % 5) * 6')} / 10", "hb": f"{_D('22 + (id % 4) * 7')} / 10", "sk": f"{_D('(id % 3) * 5')} / 10", "ground": f"{_D('(id * 7) % 40')} / 10"}
_EAVE = {"eave": f"ground + {_D('(id * 13) % 260 - 10')} / 10"}
_LOOK = {
    "ridge": f"eave + {_D('(id * 29) % 90 - 5')} / 10",
    "kind": "CASE id % 8 WHEN 0 THEN 'house' WHEN 1 THEN 'shed' WHEN 2 THEN 'garage' WHEN 3 THEN 'barn' WHEN 4 THEN 'hall' WHEN 5 THEN 'public' WHEN 6 THEN 'church' ELSE 'hut' END",
    "shape": "CASE WHEN id % 4 = 0 THEN 'flat' ELSE 'gable' END",
    "dir_x": f"CASE WHEN id % 2 = 0 THEN {_D(1)} ELSE {_D('0.6')} END",
    "dir_z": f"CASE WHEN id % 2 = 0 THEN {_D(0)} ELSE {_D('0.8')} END",
    "ridge_x": f"cx + {_D('(id % 9 - 4) * 3')} / 2",
    "ridge_z": "cz + sk / 2",
    "door_x": f"CASE WHEN id % 10 > 0 THEN cx + a * {_D('id % 5 - 2')} / 2 END",
    "door_z": f"cz - hb + sk * ({_D('id % 5 - 2')} / 2 + 1) / 2 - {_D('id % 6')} * 3 / 20",
}
#: Corners of a footprint in order; every 17th crosses itself.
_CORNERS = [("cx - a", "cz - hb"), ("cx + a", "cz - hb + sk"), ("cx + CASE WHEN id % 17 = 0 THEN -a ELSE a END", "cz + hb + CASE WHEN id % 17 = 0 THEN 0 ELSE sk END"), ("cx + CASE WHEN id % 17 = 0 THEN a ELSE -a END", "cz + hb + CASE WHEN id % 17 = 0 THEN sk ELSE 0 END")]
ROADS = {0: ("residential", 5.5, True, [(0, 20), (60, 52), (124, 30)]), 1: ("service", 3.5, True, [(20, 0), (24, 70), (60, 118)]), 2: ("track", 3.0, False, [(0, 90), (50, 80), (124, 100)]), 3: ("footway", 2.0, False, [(100, 0), (90, 60), (110, 118)])}
SEGMENTS = [(r, kind, width, drivable, i, *map(float, (*p, *q))) for r, (kind, width, drivable, pts) in ROADS.items() for i, (p, q) in enumerate(zip(pts, pts[1:]))]
PONDS = [(1, i, *map(float, (*p, *q))) for ring in [[(30, 30), (48, 34), (44, 50), (28, 46)]] for i, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1]))]
STREAMS = [(1, i, *map(float, (*p, *q))) for i, (p, q) in enumerate([((0, 110), (40, 60)), ((40, 60), (120, 70))])]
REACH, STEP = 3.0, 2.0


def _values(rows: list[tuple]) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)


_listed = lambda columns: ", ".join(f"{e} AS {n}" for n, e in columns.items())
_TOWN = f"""b0 AS (SELECT s_suppkey AS id FROM supplier), b1 AS (SELECT *, {_listed(_PLACE)} FROM b0), b2 AS (SELECT *, {_listed(_EAVE)} FROM b1), b AS (SELECT *, {_listed(_LOOK)} FROM b2),
corner AS ({" UNION ALL ".join(f"SELECT id, {i} AS i, {x} AS x, {z} AS z FROM b" for i, (x, z) in enumerate(_CORNERS))}), e AS (SELECT p.id, p.i, p.x AS x1, p.z AS z1, q.x AS x2, q.z AS z2 FROM corner p JOIN corner q ON q.id = p.id AND q.i = (p.i + 1) % 4)"""
_ROAD = f"seg(road, kind, width, drivable, i, x1, z1, x2, z2) AS (VALUES {_values(SEGMENTS)})"
_CROSS = "CASE WHEN (z2 > z) <> (z1 > z) AND x < (x2 - x1) * (z - z1) / (z2 - z1) + x1 THEN 1 ELSE 0 END"
_ALONG = "least(greatest(((x - x1) * (x2 - x1) + (z - z1) * (z2 - z1)) / ((x2 - x1) * (x2 - x1) + (z2 - z1) * (z2 - z1)), 0), 1)"
_FAR = f"sqrt((x - (x1 + {_ALONG} * (x2 - x1))) * (x - (x1 + {_ALONG} * (x2 - x1))) + (z - (z1 + {_ALONG} * (z2 - z1))) * (z - (z1 + {_ALONG} * (z2 - z1))))"


def _grid_points(low: str, high: str, step: float, name: str) -> str:
    return f"unnest(range(0, greatest(ceil(({high} - {low}) / {step}::DOUBLE - 0.5), 1)::BIGINT)) u{name}({name})"


def _samples(step: float) -> str:
    return f"""bb AS (SELECT id, min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS x9, min(least(z1, z2)) AS z0, max(greatest(z1, z2)) AS z9 FROM e GROUP BY 1),
gp AS (SELECT id, x0 + {step / 2}::DOUBLE + kx * {step}::DOUBLE AS x, z0 + {step / 2}::DOUBLE + kz * {step}::DOUBLE AS z FROM bb, {_grid_points('x0', 'x9', step, 'kx')}, {_grid_points('z0', 'z9', step, 'kz')}),
smp AS (SELECT gp.id, x, z FROM gp JOIN e ON e.id = gp.id GROUP BY gp.id, x, z HAVING sum({_CROSS}) % 2 = 1)"""


def _deep(points: str, columns: str) -> str:
    """SQL of the road in which each point lies deepest."""
    return f"SELECT {columns}, x, z, road, kind, drivable, width, depth FROM (SELECT *, row_number() OVER (PARTITION BY {columns}, x, z ORDER BY depth DESC, road, i) AS r FROM (SELECT p.*, s.* EXCLUDE (i), s.i, width / 2 - {_FAR} AS depth FROM {points} p, seg s) WHERE depth > 0) WHERE r = 1"


def _house(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    for step in (_PLACE, _EAVE, _LOOK):
        rows = rows.withColumns({n: F.expr(e) for n, e in step.items()})
    return rows


def _edges(houses: DataFrame) -> DataFrame:
    at = [(F.expr(x).cast("double"), F.expr(z).cast("double")) for x, z in _CORNERS]
    ring = [F.struct(F.lit(i).alias("i"), p[0].alias("x1"), p[1].alias("z1"), q[0].alias("x2"), q[1].alias("z2")) for i, (p, q) in enumerate(zip(at, at[1:] + at[:1]))]
    return houses.select("id", F.explode(F.array(*ring)).alias("e")).select("id", "e.*")


def _segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEGMENTS, "road int, kind string, width double, drivable boolean, i int, x1 double, z1 double, x2 double, z2 double")


def _rounded(found: DataFrame, *more: str) -> DataFrame:
    return found.select("check", "severity", "id", F.round(F.col("score") + 1e-9, 6).alias("score"), *more)


_SCORE = 'round(score + 1e-9::DOUBLE, 6) AS score'
_ORDERED = "ground < eave AND ridge >= eave - 0.01"
_limits = lambda i: f"CASE kind {' '.join(f'WHEN {k!r} THEN {v[i]}' for k, v in B.WALL_HEIGHTS.items())} ELSE {B.OTHER_WALL_HEIGHTS[i]} END"


@query(f"""WITH {_TOWN}, ar AS (SELECT id, abs(sum(x1 * z2 - x2 * z1) / 2) AS area FROM e GROUP BY 1), w AS (SELECT b.*, area, eave - ground AS wall FROM b JOIN ar USING (id)),
f AS (SELECT 'order' AS "check", 'FAIL' AS severity, id, 100 - wall AS score FROM w WHERE NOT ground < eave UNION ALL SELECT 'order', 'FAIL', id, eave - ridge FROM w WHERE ground < eave AND ridge < eave - 0.01
UNION ALL SELECT 'wall', CASE WHEN wall > {_limits(2)} THEN 'FAIL' ELSE 'WARN' END, id, wall FROM w WHERE {_ORDERED} AND (wall > {_limits(1)} OR wall < {_limits(0)} OR wall / sqrt(greatest(area, 1)) > 1.6))
SELECT "check", severity, id, {_SCORE} FROM f""")
def q_dq_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    houses = _house(spark, sf_dir)
    return _rounded(B.wall_heights(houses, _edges(houses)))


@query(f"""WITH {_TOWN}, p AS (SELECT *, ridge - eave AS rise FROM b WHERE {_ORDERED}), sp AS (SELECT p.id, any_value(rise) AS rise, (max(-dir_z * x1 + dir_x * z1) - min(-dir_z * x1 + dir_x * z1)) / 2 AS half FROM p JOIN e ON e.id = p.id WHERE shape <> 'flat' GROUP BY 1),
an AS (SELECT id, rise, degrees(atan2(rise, greatest(half, 0.1))) AS ang FROM sp), ri AS (SELECT p.id, sum({_CROSS}) AS n, min({_FAR}) AS d FROM (SELECT id, ridge_x AS x, ridge_z AS z FROM p WHERE shape <> 'flat') p JOIN e ON e.id = p.id GROUP BY 1),
f AS (SELECT 'roof_flat' AS "check", 'WARN' AS severity, id, rise AS score FROM p WHERE shape = 'flat' AND abs(rise) > 0.3
UNION ALL SELECT 'roof_pitch', CASE WHEN rise > 0.05 AND ang > 75 THEN 'FAIL' ELSE 'WARN' END, id, CASE WHEN rise <= 0.05 THEN 1 WHEN ang > 75 THEN ang ELSE abs(ang - 35) END FROM an WHERE rise <= 0.05 OR ang > 75 OR ang NOT BETWEEN 8 AND 62
UNION ALL SELECT 'roof_beside', 'WARN', id, d FROM ri WHERE n % 2 = 0 AND d > 0.5) SELECT "check", severity, id, {_SCORE} FROM f""")
def q_dq_roofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    houses = _house(spark, sf_dir)
    return _rounded(B.roofs(houses, _edges(houses)))


@query(f"""WITH {_TOWN}, t AS (SELECT a.id, a.i, c.i AS j, (a.x2-a.x1)*(c.z1-a.z1)-(a.z2-a.z1)*(c.x1-a.x1) AS o1, (a.x2-a.x1)*(c.z2-a.z1)-(a.z2-a.z1)*(c.x2-a.x1) AS o2, (c.x2-c.x1)*(a.z1-c.z1)-(c.z2-c.z1)*(a.x1-c.x1) AS o3,
  (c.x2-c.x1)*(a.z2-c.z1)-(c.z2-c.z1)*(a.x2-c.x1) AS o4 FROM e a JOIN e c ON a.id = c.id AND a.i + 2 <= c.i AND NOT (a.i = 0 AND c.i = 3)), k AS (SELECT id, count(*) AS k FROM t WHERE o1 * o2 < 0 AND o3 * o4 < 0 GROUP BY 1)
SELECT 'crossed' AS "check", CASE WHEN k > 2 THEN 'FAIL' ELSE 'WARN' END AS severity, id, round(k::DOUBLE + 1e-9::DOUBLE, 6) AS score FROM k
UNION ALL SELECT 'small', 'WARN', id, 1.0 FROM (SELECT id, abs(sum(x1 * z2 - x2 * z1) / 2) AS area FROM e GROUP BY 1) WHERE area < 2""")
def q_dq_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(B.footprints(_edges(_house(spark, sf_dir))))


@query(f"""WITH {_TOWN}, bx AS (SELECT id, min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS x9, min(least(z1, z2)) AS z0, max(greatest(z1, z2)) AS z9, abs(sum(x1 * z2 - x2 * z1) / 2) AS area FROM e GROUP BY 1),
pr AS (SELECT p.id AS a, q.id AS o, greatest(p.x0, q.x0) AS x0, least(p.x9, q.x9) AS x9, greatest(p.z0, q.z0) AS z0, least(p.z9, q.z9) AS z9, least(p.area, q.area) AS small FROM bx p JOIN bx q ON p.id < q.id AND p.x0 < q.x9 AND q.x0 < p.x9 AND p.z0 < q.z9 AND q.z0 < p.z9),
pt AS (SELECT a, o, small, x0 + 0.1::DOUBLE + kx * 0.2::DOUBLE AS x, z0 + 0.1::DOUBLE + kz * 0.2::DOUBLE AS z FROM pr, {_grid_points('x0', 'x9', 0.2, 'kx')}, {_grid_points('z0', 'z9', 0.2, 'kz')}),
i1 AS (SELECT a, o, small, x, z FROM pt JOIN e ON e.id = a GROUP BY ALL HAVING sum({_CROSS}) % 2 = 1), i2 AS (SELECT a, o, small, x, z FROM i1 JOIN e ON e.id = o GROUP BY ALL HAVING sum({_CROSS}) % 2 = 1),
m AS (SELECT a, o, small, count(*) * 0.2::DOUBLE * 0.2::DOUBLE AS score FROM i2 GROUP BY ALL) SELECT 'overlap' AS "check", CASE WHEN score / greatest(small, 1e-6) > 0.3 THEN 'FAIL' ELSE 'WARN' END AS severity, a AS id, {_SCORE}, o AS other FROM m WHERE score > 0.5""")
def q_dq_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(B.overlaps(_edges(_house(spark, sf_dir))), "other")


@query(f"""WITH {_TOWN}, {_ROAD}, {_samples(0.25)}, dp AS ({_deep("smp", "id")}), m AS (SELECT id, drivable, count(*) * 0.0625::DOUBLE AS score, max(depth) AS d FROM dp GROUP BY 1, 2)
SELECT 'on_road' AS "check", CASE WHEN drivable AND score > 10 AND d > 1.5 THEN 'FAIL' WHEN d > 0.3 AND score > CASE WHEN drivable THEN 1 ELSE 3 END THEN 'WARN' ELSE 'INFO' END AS severity, id, {_SCORE}, drivable, round(d, 6) AS depth FROM m""")
def q_dq_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.buildings_on_roads(_edges(_house(spark, sf_dir)), _segments(spark), REACH)
    return _rounded(found.withColumn("depth", F.round("depth", 6)), "drivable", "depth")


def _axis(spark: SparkSession) -> DataFrame:
    """Points along the axes of the roads to drive on, as segments of the step's length at most."""
    from terrane.operators.spatial import densified

    points = densified(_segments(spark).where("drivable"), STEP)
    return points.select("road", (F.col("i") * 1000 + F.col("k")).alias("i"), F.col("x").alias("x1"), F.col("z").alias("z1"))


_AXIS = f"""dn AS (SELECT *, CAST(greatest(ceil(sqrt((x1-x2)*(x1-x2)+(z1-z2)*(z1-z2)) / {STEP}), 1) AS INTEGER) AS n FROM seg), ax AS (SELECT road, kind, width, drivable, i, CAST(k AS INTEGER) AS k, road || ':' || (i * 1000 + k) AS p, x1 + (x2 - x1) * (k / n::DOUBLE) AS px, z1 + (z2 - z1) * (k / n::DOUBLE) AS pz,
  (x2 - x1) / sqrt((x1-x2)*(x1-x2)+(z1-z2)*(z1-z2)) AS tx, (z2 - z1) / sqrt((x1-x2)*(x1-x2)+(z1-z2)*(z1-z2)) AS tz FROM dn, unnest(range(0, n)) AS u(k))"""


@query(f"""WITH {_TOWN}, {_ROAD}, {_AXIS}, dr AS (SELECT id, door_x AS x, door_z AS z FROM b WHERE door_x IS NOT NULL), nd AS (SELECT dr.id, e.i, dr.x, dr.z, {_FAR} AS d, {_ALONG} AS t FROM dr JOIN e ON e.id = dr.id),
n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, i) AS r FROM nd) WHERE r = 1), rp AS (SELECT * FROM (SELECT dr.id, x, z, px, pz, sqrt((x-px)*(x-px)+(z-pz)*(z-pz)) AS d, row_number() OVER (PARTITION BY dr.id ORDER BY sqrt((x-px)*(x-px)+(z-pz)*(z-pz)), p) AS r FROM dr, ax WHERE drivable) WHERE r = 1),
cm AS (SELECT id, x1 AS x, z1 AS z FROM e UNION ALL SELECT id, (x1 + x2) / 2, (z1 + z2) / 2 FROM e), cl AS (SELECT id, min(sqrt((x-px)*(x-px)+(z-pz)*(z-pz))) AS least FROM cm, ax WHERE drivable GROUP BY 1),
sd AS (SELECT id, i FROM n1 UNION SELECT id, (i + 3) % 4 FROM n1 WHERE t < 0.05 UNION SELECT id, (i + 1) % 4 FROM n1 WHERE t > 0.95),
fc AS (SELECT rp.id, any_value(rp.d) AS d, max(((z2 - z1) * (px - x) - (x2 - x1) * (pz - z)) / sqrt((x2-x1)*(x2-x1)+(z2-z1)*(z2-z1)) / greatest(rp.d, 1e-6)) AS cos FROM sd JOIN e ON e.id = sd.id AND e.i = sd.i JOIN rp ON rp.id = sd.id WHERE rp.d > 2 GROUP BY 1),
f AS (SELECT 'door_off' AS "check", CASE WHEN d > 2 THEN 'FAIL' ELSE 'WARN' END AS severity, id, d AS score FROM n1 WHERE d > 0.3 UNION ALL SELECT 'door_away', CASE WHEN d - least > 8 THEN 'WARN' ELSE 'INFO' END, fc.id, CASE WHEN d - least > 8 THEN d - least ELSE -cos END FROM fc JOIN cl ON cl.id = fc.id WHERE cos < -0.3)
SELECT "check", severity, id, {_SCORE} FROM f""")
def q_dq_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    houses = _house(spark, sf_dir)
    return _rounded(B.doors(houses, _edges(houses), _axis(spark), 8.0))


@query(f"""WITH {_TOWN}, {_samples(0.5)}, pond(pond, i, x1, z1, x2, z2) AS (VALUES {_values(PONDS)}), stream(stream, i, x1, z1, x2, z2) AS (VALUES {_values(STREAMS)}),
ip AS (SELECT smp.id, pond, x, z FROM smp, pond GROUP BY ALL HAVING sum({_CROSS}) % 2 = 1), dn AS (SELECT *, CAST(greatest(ceil(sqrt((x1-x2)*(x1-x2)+(z1-z2)*(z1-z2)) / 0.5), 1) AS INTEGER) AS n FROM stream),
sp AS (SELECT stream, i AS si, k, x1 + (x2 - x1) * (k / n::DOUBLE) AS x, z1 + (z2 - z1) * (k / n::DOUBLE) AS z FROM dn, unnest(range(0, n)) AS u(k)), iw AS (SELECT stream, si, k, x, z, e.id FROM sp, e GROUP BY ALL HAVING sum({_CROSS}) % 2 = 1)
SELECT 'in_pond' AS "check", 'WARN' AS severity, id, round(count(*)::DOUBLE + 1e-9::DOUBLE, 6) AS score, pond AS other FROM ip GROUP BY id, pond HAVING count(*) * 0.25 > 1
UNION ALL SELECT 'in_stream', 'WARN', id, round(count(*)::DOUBLE + 1e-9::DOUBLE, 6), stream FROM iw GROUP BY id, stream HAVING count(*) >= 2""")
def q_dq_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda rows, name: spark.createDataFrame(rows, f"{name} int, i int, x1 double, z1 double, x2 double, z2 double")
    return _rounded(B.buildings_in_water(_edges(_house(spark, sf_dir)), line(PONDS, "pond"), line(STREAMS, "stream")), "other")


#: Things and trees derive from the customers: id, place, and for trees height over the terrain and scale.
_THING = {"x": f"{_D('(id * 31) % 1270')} / 10", "z": f"{_D('(id * 47) % 1250')} / 10", "kind": "CASE id % 3 WHEN 0 THEN 'coin' WHEN 1 THEN 'bench' ELSE 'barrel' END", "scale": f"{_D('(id * 11) % 530 - 5')} / 10", "up": f"{_D('(id * 17) % 110 - 90')} / 100 - CASE WHEN id % 97 = 0 THEN 3 ELSE 0 END"}
_THINGS = f"th AS (SELECT *, {_listed(_THING)} FROM (SELECT c_custkey AS id FROM customer)), {GRID}, hh AS (SELECT th.id, v / 100 AS h FROM th LEFT JOIN grid g ON g.ix = floor(x / 2 + 0.5) AND g.iz = floor(z / 2 + 0.5))"
_INSIDE = f"ins AS (SELECT th.id, e.id AS building FROM th, e GROUP BY th.id, x, z, e.id HAVING sum({_CROSS}) % 2 = 1)"


def _things(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).withColumns({n: F.expr(e).cast("string" if n == "kind" else "double") for n, e in _THING.items()})
    return R.gathered(rows, grid(spark, sf_dir), "x", "z", "v", "h", cell=2.0).withColumn("h", F.col("h") / 100)


@query(f"""WITH {_TOWN}, {_ROAD}, {_THINGS}, {_INSIDE}, o AS (SELECT * FROM th WHERE id NOT IN (SELECT id FROM ins)), dp AS ({_deep("(SELECT id, x, z FROM o WHERE kind <> 'coin')", "id")})
SELECT 'item_inside' AS "check", 'WARN' AS severity, id, 2.0::DOUBLE AS score FROM (SELECT DISTINCT id FROM ins) UNION ALL SELECT 'item_on_road', 'WARN', id, 1.0 FROM dp UNION ALL SELECT 'item_off_grid', 'WARN', o.id, 1.0 FROM o JOIN hh ON hh.id = o.id WHERE h IS NULL""")
def q_dq_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    things = _things(spark, sf_dir)
    return _rounded(B.items(things.select("id", "kind", "x", "z"), _edges(_house(spark, sf_dir)), _segments(spark), things.select("id", "h"), REACH, ["coin"]))


@query(f"""WITH {_TOWN}, {_samples(1.0)}, {GRID}, hp AS (SELECT smp.id, (v - 450) / 600::DOUBLE AS d FROM smp LEFT JOIN grid g ON g.ix = floor(x / 2 + 0.5) AND g.iz = floor(z / 2 + 0.5)),
m AS (SELECT id, avg((ground + d) - ground) AS mean, max(abs((ground + d) - ground)) AS score, count(*) - count(d) AS none FROM hp JOIN b USING (id) GROUP BY 1), f AS (SELECT 'ground_off_grid' AS "check", 'WARN' AS severity, id, 1.0::DOUBLE AS score FROM m WHERE none > 0
UNION ALL SELECT 'ground', CASE WHEN abs(mean) > 0.6 OR score > 2 THEN 'FAIL' ELSE 'WARN' END, id, score FROM m WHERE none = 0 AND (abs(mean) > 0.15 OR score > 0.5)) SELECT "check", severity, id, {_SCORE} FROM f""")
def q_dq_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    houses = _house(spark, sf_dir)
    points = R.gathered(B.samples(_edges(houses), 1.0), grid(spark, sf_dir), "x", "z", "v", "v", cell=2.0)
    heights = points.join(houses.select("id", "ground"), "id").select("id", (F.col("ground") + (F.col("v") - 450) / 600).alias("h"))
    return _rounded(B.ground_under(houses.select("id", "ground"), heights))


#: Profiles of the roads: points along the axes with the terrain there and at both sides.
_near = lambda x, z: f"g.ix = floor({x} / 2 + 0.5) AND g.iz = floor({z} / 2 + 0.5)"
_PROFILE = f"""{_ROAD}, {_AXIS}, {GRID}, pf AS (SELECT ax.road, ax.drivable, ax.width, row_number() OVER (PARTITION BY ax.road ORDER BY ax.i, ax.k) - 1 AS k, (row_number() OVER (PARTITION BY ax.road ORDER BY ax.i, ax.k) - 1) * {STEP}::DOUBLE AS s, g.v / 100 AS h, l.v / 100 AS lh, r.v / 100 AS rh
FROM ax JOIN grid g ON {_near("px", "pz")} LEFT JOIN grid l ON {_near("(px - tz * width / 2)", "(pz + tx * width / 2)").replace("g.", "l.")} LEFT JOIN grid r ON {_near("(px + tz * width / 2)", "(pz - tx * width / 2)").replace("g.", "r.")})"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from terrane.operators.spatial import densified

    points = densified(_segments(spark), STEP)
    long = F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("z1") - F.col("z2")) * (F.col("z1") - F.col("z2")))
    points = points.withColumns({"tx": (F.col("x2") - F.col("x1")) / long, "tz": (F.col("z2") - F.col("z1")) / long})
    points = points.withColumns({"lx": F.expr("x - tz * width / 2"), "lz": F.expr("z + tx * width / 2"), "rx": F.expr("x + tz * width / 2"), "rz": F.expr("z - tx * width / 2")})
    for x, z, name in (("x", "z", "h"), ("lx", "lz", "left"), ("rx", "rz", "right")):
        points = R.gathered(points, grid(spark, sf_dir), x, z, "v", name, cell=2.0).withColumn(name, F.col(name) / 100)
    along = Window.partitionBy("road").orderBy("i", "k")
    at = F.row_number().over(along) - 1
    return points.where("h IS NOT NULL").withColumn("_at", at).select("road", "drivable", "width", F.col("_at").alias("k"), (F.col("_at") * STEP).alias("s"), "h", "left", "right")


@query(f"""WITH {_PROFILE}, j AS (SELECT road, drivable, k, lead(h) OVER (PARTITION BY road ORDER BY k) - h AS j FROM pf), q AS (SELECT *, row_number() OVER (PARTITION BY road ORDER BY k) AS n, count(*) OVER (PARTITION BY road) AS m FROM j WHERE j IS NOT NULL),
md AS (SELECT a.road, a.drivable, a.k, any_value(a.j) AS j, any_value(a.m) AS m, median(c.j) AS med FROM q a, unnest([-2, -1, 0, 1, 2]) o(d) JOIN q c ON c.road = a.road AND c.n = least(greatest(a.n + d, 1), a.m) GROUP BY 1, 2, 3),
bad AS (SELECT *, row_number() OVER (PARTITION BY road ORDER BY abs(j - med) DESC, k) AS r FROM md WHERE m >= 5 AND abs(j) > 0.35 AND abs(j - med) > 0.25), f AS (SELECT 'step' AS "check", CASE WHEN drivable AND abs(j) > 1 THEN 'FAIL' ELSE 'WARN' END AS severity, road AS id, abs(j - med) AS score FROM bad WHERE r = 1) SELECT "check", severity, id, {_SCORE} FROM f""")
def q_dq_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(B.road_steps(_profile(spark, sf_dir)))


@query(f"""WITH {_PROFILE}, g1 AS (SELECT road, drivable, abs(lead(h, 5) OVER w - h) / greatest(lead(s, 5) OVER w - s, 1e-3) AS g FROM pf WINDOW w AS (PARTITION BY road ORDER BY k)),
m AS (SELECT road, drivable, max(g) AS score, count(*) FILTER (g > 0.15) * {STEP}::DOUBLE AS lw, count(*) FILTER (g > 0.25) * {STEP}::DOUBLE AS lf FROM g1 WHERE g IS NOT NULL GROUP BY 1, 2)
SELECT 'grade' AS "check", CASE WHEN drivable AND lf >= 10 THEN 'FAIL' WHEN lw >= 20 THEN 'WARN' ELSE 'INFO' END AS severity, road AS id, {_SCORE} FROM m WHERE score > 0.15""")
def q_dq_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(B.road_grades(_profile(spark, sf_dir), 5, STEP))


@query(f"""WITH {_PROFILE}, m AS (SELECT road, drivable, quantile_cont(abs(lh - rh) / width, 0.9) AS score FROM pf WHERE width >= 3 AND lh IS NOT NULL AND rh IS NOT NULL GROUP BY 1, 2)
SELECT 'crossfall' AS "check", CASE WHEN drivable AND score > 0.25 THEN 'FAIL' ELSE 'WARN' END AS severity, road AS id, {_SCORE} FROM m WHERE score > 0.1""")
def q_dq_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(B.road_crossfalls(_profile(spark, sf_dir)))


@query(f"""WITH {_TOWN}, {_ROAD}, {_THINGS}, {_INSIDE}, y AS (SELECT th.*, h, h + up - h AS dy FROM th JOIN hh USING (id)), dh AS (SELECT ins.id, min({_FAR}) AS d FROM ins JOIN th ON th.id = ins.id JOIN e ON e.id = ins.building GROUP BY 1), dp AS ({_deep("(SELECT id, x, z FROM th)", "id")}),
f AS (SELECT 'tree_inside' AS "check", CASE WHEN d > 1 THEN 'FAIL' ELSE 'WARN' END AS severity, id, d AS score FROM dh UNION ALL SELECT 'tree_on_road', CASE WHEN width / 2 - depth < 1 AND kind <> 'service' THEN 'FAIL' ELSE 'WARN' END, id, depth FROM dp WHERE depth > 0.3 AND drivable
UNION ALL SELECT 'tree_height', CASE WHEN dy < -3 THEN 'FAIL' ELSE 'WARN' END, id, abs(dy) FROM y WHERE dy NOT BETWEEN -0.6::DOUBLE AND 0.1::DOUBLE UNION ALL SELECT 'tree_scale', 'WARN', id, scale FROM th WHERE scale <= 0 OR scale > 50) SELECT "check", severity, id, {_SCORE} FROM f""")
def q_dq_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _things(spark, sf_dir).withColumn("y", F.col("h") + F.col("up")).drop("kind")
    return _rounded(B.trees(rows, _edges(_house(spark, sf_dir)), _segments(spark), REACH))


@query(f"""WITH {_TOWN}, {_ROAD}, {_THINGS}, {_INSIDE}, y AS (SELECT th.id, h + up - h AS dy FROM th JOIN hh USING (id)), dp AS ({_deep("(SELECT id, x, z FROM th)", "id")}), n AS (SELECT count(*) AS total FROM th),
f AS (SELECT 'plant_inside' AS "check", count(DISTINCT id) AS n FROM ins UNION ALL SELECT 'plant_on_road', count(*) FROM dp WHERE depth > 0.2 UNION ALL SELECT 'plant_height', count(*) FROM y WHERE dy NOT BETWEEN -0.3::DOUBLE AND 0.15::DOUBLE)
SELECT "check", CASE WHEN n / total > 0.05 THEN 'FAIL' WHEN n / total > 0.002 THEN 'WARN' ELSE 'INFO' END AS severity, n, round(n / total, 9) AS share FROM f, n WHERE n > 0""")
def q_dq_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _things(spark, sf_dir).withColumn("y", F.col("h") + F.col("up")).drop("kind")
    return B.plants(rows, _edges(_house(spark, sf_dir)), _segments(spark), REACH).withColumn("share", F.round("share", 9))


#: A mesh from the items: a tile an order, a vertex an item.
_VERTEX = {"x": f"{_D('tile % 100')}", "y": f"{_D('v * v')}", "z": f"{_D('v * (tile % 3)')}", "nx": "CASE WHEN (tile + v) % 41 = 0 THEN " + _D("0.9") + " ELSE " + _D(1) + " END", "ny": _D(0), "nz": _D(0), "r": f"{_D('(tile * 7 + v) % 103')} / 101", "g": _D(0), "b": _D(1)}
_MESH = f"vx AS (SELECT *, {_listed(_VERTEX)} FROM (SELECT l_orderkey AS tile, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS v FROM lineitem))"


@query(f"""WITH {_MESH}, k AS (SELECT tile, count(*) AS k FROM vx GROUP BY 1), c AS (SELECT p.x AS x0, p.y AS y0, p.z AS z0, q.x AS x1, q.y AS y1, q.z AS z1, r.x AS x2, r.y AS y2, r.z AS z2 FROM vx p JOIN vx q ON q.tile = p.tile AND q.v = p.v + 1 JOIN vx r ON r.tile = p.tile AND r.v = p.v + 2 WHERE p.v % 3 = 0),
t AS (SELECT sqrt(pow((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0), 2) + pow((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0), 2) + pow((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0), 2)) / 2 AS area FROM c),
f AS (SELECT 'odd_tile' AS "check", count(*) FILTER (k % 3 <> 0) AS n, count(*) AS m FROM k UNION ALL SELECT 'flat_triangle', count(*) FILTER (NOT area > 1e-6), count(*) FROM t UNION ALL SELECT 'normal', count(*) FILTER (abs(nx - 1) > 0.02), count(*) FROM vx UNION ALL SELECT 'colour', count(*) FILTER (r > 1.0001), count(*) FROM vx)
SELECT "check", n, round(n / m, 9) AS share, CASE WHEN "check" = 'odd_tile' THEN 'FAIL' WHEN "check" = 'flat_triangle' AND n / m <= 0.001 THEN 'INFO' ELSE 'WARN' END AS severity FROM f WHERE n > 0""")
def q_dq_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tile"), at.alias("v")).withColumns({n: F.expr(e) for n, e in _VERTEX.items()})
    return B.mesh(rows).select("check", "n", F.round("share", 9).alias("share"), "severity")


@query(f"""WITH {_TOWN}, {GRID}, ft AS (SELECT e.id, ground - 1 AS y, ground + (v - 450) / 200::DOUBLE AS h FROM e JOIN b ON b.id = e.id JOIN grid g ON {_near("x1", "z1")}), m AS (SELECT id, y - h AS gap, row_number() OVER (PARTITION BY id ORDER BY abs(y - h) DESC, y - h DESC) AS r FROM ft WHERE y - h > 0.15::DOUBLE OR y - h < -1.5),
f AS (SELECT 'wall_foot' AS "check", CASE WHEN gap > 0.5 THEN 'FAIL' ELSE 'WARN' END AS severity, id, abs(gap) AS score FROM m WHERE r = 1 UNION ALL SELECT 'roof_top', 'WARN', id, abs(ridge + (id % 7 - 3) / 4::DOUBLE - ridge) FROM b WHERE abs(ridge + (id % 7 - 3) / 4::DOUBLE - ridge) > 0.6)
SELECT "check", severity, id, {_SCORE} FROM f""")
def q_dq_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    houses = _house(spark, sf_dir)
    feet = R.gathered(_edges(houses), grid(spark, sf_dir), "x1", "z1", "v", "v", cell=2.0).where("v IS NOT NULL").join(houses.select("id", "ground"), "id")
    found = B.wall_feet(feet.select("id", (F.col("ground") - 1).alias("y"), (F.col("ground") + (F.col("v") - 450) / 200).alias("h")))
    tops = houses.select("id", (F.col("ridge") + (F.col("id") % 7 - 3) / 4).alias("y"))
    return _rounded(found.unionByName(B.roof_tops(houses.select("id", "ridge"), tops.unionByName(tops.select("id", (F.col("y") - 1).alias("y"))))))


_BUFFERS, _LEAST = {"residential": 2.5, "service": 1.5, "track": 1.2}, {"residential": 1.0, "service": 3.0, "track": 1.0}


@query(f"""WITH {_TOWN}, {_ROAD}, {_samples(0.25)}, lim(kind, buf, need) AS (VALUES {_values([(k, float(v), float(_LEAST[k])) for k, v in _BUFFERS.items()])}), c AS (SELECT id, kind, x, z, min(d) AS d, any_value(need) AS need FROM (SELECT smp.*, seg.kind, need, buf, {_FAR} AS d FROM smp, seg JOIN lim ON lim.kind = seg.kind) WHERE d < buf GROUP BY 1, 2, 3, 4),
m AS (SELECT id, kind, count(*) * 0.0625::DOUBLE AS m2, min(d) AS d, any_value(need) AS need FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind) AS r FROM m WHERE m2 >= need) SELECT id, kind, round(m2, 6) AS m2, round(d, 6) AS d FROM r WHERE r = 1""")
def q_dq_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.road_clashes(_edges(_house(spark, sf_dir)), _segments(spark), _BUFFERS, _LEAST)
    return found.select("id", "kind", F.round("m2", 6).alias("m2"), F.round("d", 6).alias("d"))
