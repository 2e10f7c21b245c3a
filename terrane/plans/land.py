"""Queries: edited surfaces, connected areas, flow, what lies around places, calendars, filters of geometry and JSON, streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import environment as V
from terrane.functions import geometry as G
from terrane.functions import scalars as S
from terrane.operators import faces
from terrane.operators import folds as M
from terrane.operators import land as L
from terrane.operators import raster as R
from terrane.operators import sequences as Q
from terrane.operators import spatial as J
from terrane.operators import stats as A
from terrane.operators.alignment import aligned
from terrane.operators.distance import transformed
from terrane.operators.ranks import quantiles
from terrane.plans.models import HULL_SQL
from terrane.plans.registry import Registry
from terrane.plans.space import CENTROIDS, DIST, EDGES_SQL, PLANE, ROAD_EDGES, ROAD_SQL, plane, rings
from terrane.plans.statistics import GRID, grid
from terrane.plans.streams import event_stream
from terrane.session import table
from terrane.streaming import events as E

registry = Registry()
query = registry.query

_MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > {1} THEN 2 * {1} - ({0}) ELSE {0} END".format


@query(f"""WITH {GRID}, m AS (SELECT max(ix) AS hx, max(iz) AS hz FROM grid), o AS (SELECT CAST(dx AS INTEGER) AS dx, CAST(dz AS INTEGER) AS dz FROM range(-2, 3) a(dx), range(-2, 3) b(dz))
SELECT a.ix, a.iz, round(sum(b.v) / 25, 6) AS m FROM grid a CROSS JOIN o CROSS JOIN m JOIN grid b ON b.ix = {_MIRROR("a.ix + dx", "hx")} AND b.iz = {_MIRROR("a.iz + dz", "hz")} GROUP BY 1, 2""")
def q_box_mean_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.box_mean_reflected(grid(spark, sf_dir), "v", 2, "m").select("ix", "iz", F.round("m", 6).alias("m"))


_BLOCK = f"{GRID}, blk AS (SELECT ix, iz, v * 0.9::DOUBLE + 50 AS b FROM grid WHERE ix BETWEEN 20 AND 40 AND iz BETWEEN 24 AND 36), outer_ AS (SELECT g.* FROM grid g ANTI JOIN blk USING (ix, iz)), beside AS (SELECT o.ix, o.iz, v, b FROM outer_ o JOIN blk ON abs(o.ix - blk.ix) + abs(o.iz - blk.iz) = 1)"


def _block(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = grid(spark, sf_dir)
    return cells, cells.where("ix BETWEEN 20 AND 40 AND iz BETWEEN 24 AND 36").select("ix", "iz", (F.col("v") * 0.9 + 50).alias("v"))


@query(f"""WITH {_BLOCK}, nr AS (SELECT o.ix, o.iz, o.v, r.b - r.v AS step, sqrt((o.ix - r.ix) * (o.ix - r.ix) + (o.iz - r.iz) * (o.iz - r.iz)) AS d, row_number() OVER (PARTITION BY o.ix, o.iz ORDER BY sqrt((o.ix - r.ix) * (o.ix - r.ix) + (o.iz - r.iz) * (o.iz - r.iz)), r.ix, r.iz) AS n FROM outer_ o, beside r)
SELECT ix, iz, round(CASE WHEN d <= 10 THEN v + step * (1 - d / 10) ELSE v END, 6) AS v FROM nr WHERE n = 1 UNION ALL SELECT ix, iz, round(b, 6) FROM blk""")
def q_feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.feathered(*_block(spark, sf_dir), "v", 10).select("ix", "iz", F.round("v", 6).alias("v"))


@query(f"WITH {_BLOCK} SELECT round(avg(abs(v - b)), 6) AS mean, round(quantile_cont(abs(v - b), 0.95), 6) AS p95, round(max(abs(v - b)), 6) AS max FROM beside")
def q_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.seam(*_block(spark, sf_dir), "v").select(*[F.round(c, 6).alias(c) for c in ("mean", "p95", "max")])


_LINE = [(line, k, 10.0 + 2 * k + line, 20.0 + (k * k) % 7 + 30 * line) for line in (0, 1) for k in range(26)] + [(2, 0, 5.0, 5.0), (2, 1, 9.0, 5.0)]


@query(f"""WITH {GRID}, p(line, k, x, z) AS (VALUES {", ".join(f"({a}, {b}, {x}::DOUBLE, {z}::DOUBLE)" for a, b, x, z in _LINE)}), t AS (SELECT *, count(*) OVER (PARTITION BY line) AS n, CASE WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END AS tx,
  CASE WHEN lag(z) OVER w IS NULL THEN lead(z) OVER w - z WHEN lead(z) OVER w IS NULL THEN z - lag(z) OVER w ELSE (lead(z) OVER w - lag(z) OVER w) / 2 END AS tz FROM p WINDOW w AS (PARTITION BY line ORDER BY k)),
nm AS (SELECT *, -tz / sqrt(tx * tx + tz * tz) AS nx, tx / sqrt(tx * tx + tz * tz) AS nz FROM t), c AS (SELECT nm.line, nm.k, o, coalesce(v, 1e300) + abs(o) * 0.04::DOUBLE AS cost FROM nm CROSS JOIN range(-6, 7) r(o) LEFT JOIN grid g ON g.ix = floor((x + nx * o) / 2 + 0.5) AND g.iz = floor((z + nz * o) / 2 + 0.5)),
b AS (SELECT line, k, o AS best FROM (SELECT *, row_number() OVER (PARTITION BY line, k ORDER BY cost, o) AS r FROM c) WHERE r = 1), sm AS (SELECT a.line, a.k, avg(q.best) AS m FROM b a, range(-4, 5) d(d), (SELECT line, max(k) AS hi FROM p GROUP BY 1) h, b q WHERE h.line = a.line AND q.line = a.line AND q.k = least(greatest(a.k + d, 0), hi) GROUP BY 1, 2)
SELECT nm.line, nm.k, round(CASE WHEN n >= 3 THEN x + nx * m ELSE x END, 6) AS x, round(CASE WHEN n >= 3 THEN z + nz * m ELSE z END, 6) AS z FROM nm JOIN sm ON sm.line = nm.line AND sm.k = nm.k""")
def q_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame(_LINE, "line int, k int, x double, z double")
    return L.snapped(lines, grid(spark, sf_dir), "v", 6, 2.0).select("line", "k", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


_BEDS = [(0, 5.0, 10.0, 60.0, 40.0, 300.0, 250.0), (1, 60.0, 40.0, 100.0, 115.0, 250.0, 180.0)]
_T = "least(greatest(((x - x1) * (x2 - x1) + (z - z1) * (z2 - z1)) / ((x2 - x1) * (x2 - x1) + (z2 - z1) * (z2 - z1)), 0), 1)"


@query(f"""WITH {GRID}, bed(seg, x1, z1, x2, z2, b1, b2) AS (VALUES {", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in b) + ")" for b in _BEDS)}), m AS (SELECT ix, iz, v, seg, b1, b2, x, z, x1, z1, x2, z2, {_T} AS t FROM (SELECT *, ix * 2.0::DOUBLE AS x, iz * 2.0::DOUBLE AS z FROM grid), bed),
d AS (SELECT *, sqrt((x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (z - (z1 + t * (z2 - z1))) * (z - (z1 + t * (z2 - z1)))) AS d FROM m), n AS (SELECT *, row_number() OVER (PARTITION BY ix, iz ORDER BY d, seg) AS r FROM d)
SELECT ix, iz, round(CASE WHEN d <= 9 AND ix % 7 <> 0 THEN least(v, b1 + (b2 - b1) * t + greatest(d - 1.5, 0) * 12) ELSE v END, 6) AS v FROM n WHERE r = 1""")
def q_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    beds = spark.createDataFrame(_BEDS, "seg int, x1 double, z1 double, x2 double, z2 double, b1 double, b2 double")
    cells = grid(spark, sf_dir)
    return L.carved(cells, "v", beds, 1.5, 12.0, 9.0, cells.where("ix % 7 = 0"), 2.0).select("ix", "iz", F.round("v", 6).alias("v"))


@query(f"""WITH RECURSIVE {GRID}, c AS (SELECT ix, iz, ix * 100 + iz AS id FROM grid WHERE v > 520), reach(id, other) AS (SELECT id, id FROM c UNION SELECT r.id, n.id FROM reach r JOIN c o ON o.id = r.other JOIN c n ON abs(n.ix - o.ix) + abs(n.iz - o.iz) = 1),
l AS (SELECT id, min(other) AS area FROM reach GROUP BY 1) SELECT area // 100 AS ax, area % 100 AS az, count(*) AS n, min(ix) AS x0, max(ix) AS x1, min(iz) AS z0, max(iz) AS z1 FROM l JOIN c USING (id) GROUP BY area""")
def q_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.areas(grid(spark, sf_dir).where("v > 520").select("ix", "iz"))
    return found.select(F.expr("area div 4294967296").cast("int").alias("ax"), (F.col("area") % (1 << 32)).cast("int").alias("az"), "n", "x0", "x1", "z0", "z1")


@query(f"""WITH RECURSIVE {GRID}, d AS (SELECT a.ix, a.iz, b.ix AS tx, b.iz AS tz, row_number() OVER (PARTITION BY a.ix, a.iz ORDER BY (a.v - b.v) / sqrt((a.ix - b.ix) * (a.ix - b.ix) + (a.iz - b.iz) * (a.iz - b.iz)) DESC, b.iz, b.ix) AS r FROM grid a JOIN grid b ON abs(a.ix - b.ix) <= 1 AND abs(a.iz - b.iz) <= 1 AND (a.ix <> b.ix OR a.iz <> b.iz) AND a.v > b.v),
down AS (SELECT ix, iz, tx, tz FROM d WHERE r = 1), w(ix, iz) AS (SELECT ix, iz FROM grid UNION ALL SELECT tx, tz FROM w JOIN down USING (ix, iz)) SELECT ix, iz, count(*)::DOUBLE AS total FROM w GROUP BY 1, 2""")
def q_flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.flow_totals(grid(spark, sf_dir), "v")


@query(f"""WITH {PLANE}, n AS (SELECT a.vec_id, b.label AS kind, count(*) AS n FROM plane a JOIN plane b ON a.vec_id % 10 = 0 AND {DIST} <= 0.1 GROUP BY 1, 2) SELECT vec_id, kind, round(n / sum(n) OVER (PARTITION BY vec_id), 9) AS share FROM n""")
def q_species_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = plane(spark, sf_dir)
    shares = L.shares_near(points.where("vec_id % 10 = 0"), "vec_id", points.withColumnRenamed("label", "kind"), "kind", 0.1)
    return shares.select("vec_id", "kind", F.round("share", 9).alias("share"))


@query(f"""WITH {PLANE}, {CENTROIDS}, s AS (SELECT a.label AS home, b.vec_id AS event, row_number() OVER (PARTITION BY a.label ORDER BY b.vec_id % 97 DESC, b.vec_id DESC) - 1 AS age FROM cent a JOIN plane b ON {DIST} <= 0.1) SELECT home, event, CAST(age AS INTEGER) AS age FROM s WHERE age < 40""")
def q_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = plane(spark, sf_dir)
    homes = points.groupBy(F.col("label").alias("home")).agg(F.avg("x").alias("x"), F.avg("z").alias("z"))
    events = points.select(F.col("vec_id").alias("event"), (F.col("vec_id") % 97).alias("at"), "x", "z")
    return L.witnessed(events, "event", "at", homes, "home", 0.1)


# A figure a label: its points, closed where the label isn't a multiple of 3; and one of each first point alone.
@query(f"""WITH {EDGES_SQL}, p AS (SELECT poly AS id, i, x, z FROM rings UNION ALL SELECT poly, n, x, z FROM rings WHERE i = 0 AND poly % 3 > 0 UNION ALL SELECT poly + 1000, 0, x, z FROM rings WHERE i = 0),
f AS (SELECT id, count(*) AS n, arg_min(x, i) = arg_max(x, i) AND arg_min(z, i) = arg_max(z, i) AS closed, bool_or(x BETWEEN 0.25 AND 0.5 AND z BETWEEN 0.0 AND 0.35) AS near, max(i) AS last FROM p GROUP BY 1)
SELECT f.id, any_value(n >= 4 AND closed) AS ring, any_value(n >= 2) AS line, any_value(near) AS near, round(avg(x), 9) AS cx, round(avg(z), 9) AS cz FROM f JOIN p ON p.id = f.id AND NOT (closed AND n > 1 AND p.i = last) GROUP BY 1""")
def q_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rings(spark, sf_dir).select(F.col("poly").alias("id"), "i", "x", "z", "n")
    closing, alone = own.where("i = 0 AND id % 3 > 0").withColumn("i", F.col("n")), own.where("i = 0").withColumn("id", F.col("id") + 1000)
    points = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "z"))), lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z")))
    rows = own.unionByName(closing.withColumn("i", F.col("i").cast("int"))).unionByName(alone).groupBy("id").agg(points.alias("pts"))
    cx, cz = G.vertex_mean(F.col("pts"))
    return rows.select("id", G.is_ring(F.col("pts")).alias("ring"), G.is_line(F.col("pts")).alias("line"), G.any_within(F.col("pts"), 0.25, 0.5, 0.0, 0.35).alias("near"), F.round(cx, 9).alias("cx"), F.round(cz, 9).alias("cz"))


_EASTER = "make_date(y, ((h + l - 7 * m + 114) // 31)::INT, ((h + l - 7 * m + 114) % 31 + 1)::INT)"


@query(f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), y AS (SELECT DISTINCT year(day) AS y FROM d), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), b AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a),
c AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM b), e AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM c), s AS (SELECT y, {_EASTER} AS sunday FROM e), t AS (SELECT day, sunday, make_date(y, 3, 31) - (isodow(make_date(y, 3, 31)) % 7)::INT AS summer, make_date(y, 10, 31) - (isodow(make_date(y, 10, 31)) % 7)::INT AS winter FROM d JOIN s ON s.y = year(day))
SELECT strftime(day, '%Y-%m-%d') AS day, strftime(day, '%m-%d') IN {S.HOLIDAYS} OR day = sunday - 2 OR day = sunday + 1 AS holiday, CASE WHEN day >= summer AND day < winter THEN 2 ELSE 1 END AS utc_offset FROM t""")
def q_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), S.is_holiday(F.col("day")).alias("holiday"), S.utc_offset(F.col("day")).alias("utc_offset"))


@query("""SELECT event_id, coalesce(round(try_cast(json_extract_string(props, '$.k') AS DOUBLE) / 1, 3), -1) AS k, coalesce(round(try_cast(json_extract_string(props, '$.none') AS DOUBLE), 3), 7) AS none FROM events""")
def q_json_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.json_number(F.col("props"), "$.k", -1.0).alias("k"), S.json_number(F.col("props"), "$.none", 7.0).alias("none"))


@query(f"""WITH {GRID}, c AS (SELECT ix, iz, v / 100 AS hand, ix * 3 AS water, iz / 6::DOUBLE AS twi, ix * 7 % 50 AS slope, iz % 5 - 2 AS tpi, {S.hash01_sql("ix", "iz", seed=5)} AS noise FROM grid), q AS (SELECT quantile_cont(twi, 0.8) AS wet, quantile_cont(twi, 0.4) AS dry FROM c)
SELECT ix, iz, CASE WHEN hand < 2 AND water < 60 THEN 'fluvisol' WHEN twi > wet THEN 'gleysol' WHEN slope > 20 AND tpi > 0 THEN 'ranker' WHEN slope < 8 AND twi < dry AND noise < 0.4 THEN 'arenosol' ELSE 'luvisol' END AS soil FROM c, q""")
def q_soil_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).withColumn("twi", F.col("iz") / 6)
    limits = quantiles(cells, [], "twi", {"wet": 0.8, "dry": 0.4})
    soil = V.soil_kind(F.col("v") / 100, F.col("ix") * 3, F.col("twi"), F.col("ix") * 7 % 50, F.col("iz") % 5 - 2, S.hash01(F.col("ix"), F.col("iz"), seed=5), F.col("wet"), F.col("dry"), 0.4)
    return cells.crossJoin(F.broadcast(limits)).select("ix", "iz", soil.alias("soil"))  # one row of limits


@query("SELECT p_brand, arg_min(p_type, row(p_retailprice + 10 * p_size, p_type)) AS p_type, round(min(p_retailprice + 10 * p_size), 6) AS penalised FROM part GROUP BY 1")
def q_best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best_model(table(spark, sf_dir, "part"), ["p_brand"], "p_type", "p_retailprice", "p_size", 10.0).withColumn("penalised", F.round("penalised", 6))


@query(f"WITH {GRID} SELECT round(count(*) FILTER (v > 350 AND v < 450) / count(*) FILTER (v > 350 OR v < 450), 9) AS iou FROM grid")
def q_overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return A.overlap_ratio(cells.where("v > 350"), cells.where("v < 450"), ["ix", "iz"]).select(F.round("iou", 9).alias("iou"))


@query(f"WITH {PLANE} SELECT " + ", ".join(f"round(-1.0::DOUBLE + {f}(({a}({c}) + 1.0::DOUBLE) / 0.07::DOUBLE) * 0.07::DOUBLE, 9) AS {c}{n}" for c in "xz" for f, a, n in (("floor", "min", 0), ("ceil", "max", 1))) + " FROM plane")
def q_snapped_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.snapped_extent(plane(spark, sf_dir), "x", "z", -1.0, 0.07)
    return found.select(*[F.round(c, 9).alias(c) for c in ("x0", "x1", "z0", "z1")])


@query("SELECT DISTINCT user_id, event_type FROM events")
def q_stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = E.first_in_watermark(event_stream(spark, sf_dir), ["user_id", "event_type"], "ts", "60 days")
    return E.every_update(first.select("user_id", "event_type"), "first", "append")


@query("""WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, strftime(any_value(last), '%Y-%m-%d %H:%M:%S') AS last, round(sum(value * exp(-((epoch_us(last) - epoch_us(ts)) / 1000000.0::DOUBLE) / 432000.0::DOUBLE)), 3) AS level FROM events JOIN l USING (user_id) GROUP BY 1""")
def q_stream_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = E.decaying_tiles(event_stream(spark, sf_dir), "user_id", "ts", "value", 432000.0, 100 * 86400.0)
    return E.latest_result(tiles, "tiles", ["user_id"]).select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last"), F.round("level", 3).alias("level"))


@query("""WITH k AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'debt' ELSE 'paid' END AS kind, value FROM events WHERE event_type IN ('purchase', 'view')), p AS (SELECT *, lag(kind) OVER w AS before FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT * FROM p WHERE kind <> coalesce(before, 'paid')), r AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS owed FROM c) SELECT user_id, CASE kind WHEN 'debt' THEN 'open' ELSE 'paid' END AS status, round(CASE kind WHEN 'debt' THEN value ELSE owed END, 6) AS amount FROM r""")
def q_stream_debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = event_stream(spark, sf_dir).where("event_type IN ('purchase', 'view')")
    debts = kinds.select("user_id", "ts", F.when(F.col("event_type") == "purchase", "debt").otherwise("paid").alias("kind"), F.col("value").alias("amount"))
    changes = E.debts(debts, "user_id", "ts", 400 * 86400, 500 * 86400, 5.0)
    return E.every_update(changes, "debts", "update").select("user_id", "status", F.round("amount", 6).alias("amount"))


_ROAD = ROAD_SQL + f", t AS (SELECT vec_id, seg, x, z, x1, z1, x2, z2, {_T} AS t FROM plane, road), d AS (SELECT vec_id, seg, sqrt((x-(x1+t*(x2-x1)))*(x-(x1+t*(x2-x1)))+(z-(z1+t*(z2-z1)))*(z-(z1+t*(z2-z1)))) AS d FROM t)"


@query(f"WITH {PLANE}, {_ROAD} SELECT vec_id, seg, round(d, 9) AS d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, seg) AS r FROM d) WHERE r = 1")
def q_nearest_segment_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    road = spark.createDataFrame(ROAD_EDGES, "seg int, x1 double, z1 double, x2 double, z2 double")
    return J.nearest_segment_any(plane(spark, sf_dir), "vec_id", road, "seg", 0.02).select("vec_id", "seg", F.round("d", 9).alias("d"))


@query(f"""WITH {GRID}, w AS (SELECT ix AS wx, iz AS wz, v AS wv FROM grid WHERE ix % 9 = 4 AND iz % 7 < 2), n AS (SELECT g.ix, g.iz, wx, wz, v - wv AS hand, sqrt((ix - wx) * (ix - wx) + (iz - wz) * (iz - wz)) AS d, row_number() OVER (PARTITION BY g.ix, g.iz ORDER BY sqrt((ix - wx) * (ix - wx) + (iz - wz) * (iz - wz)), wx, wz) AS r FROM grid g, w)
SELECT ix, iz, wx, wz, round(d, 9) AS d, round(hand, 6) AS hand FROM n WHERE r = 1""")
def q_nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    near = transformed(cells.withColumn("water", F.expr("ix % 9 = 4 AND iz % 7 < 2")), "water").select("ix", "iz", F.col("nx").alias("wx"), F.col("nz").alias("wz"), F.sqrt("square").alias("d"))
    met = near.join(cells, ["ix", "iz"]).join(cells.select(F.col("ix").alias("wx"), F.col("iz").alias("wz"), F.col("v").alias("_w")), ["wx", "wz"])
    return met.select("ix", "iz", "wx", "wz", F.round("d", 9).alias("d"), F.round(F.col("v") - F.col("_w"), 6).alias("hand"))


_SHIFTS = [(dx, dz) for dx in range(-2, 3) for dz in range(-2, 3)]


@query(f"""WITH {GRID}, a AS (SELECT ix, iz FROM grid WHERE v > 420), b AS (SELECT ix + 1 AS ix, iz - 2 AS iz FROM grid WHERE v > 430), s(k, dx, dz) AS (VALUES {", ".join(f"({k}, {dx}, {dz})" for k, (dx, dz) in enumerate(_SHIFTS))}),
c AS (SELECT k, dx, dz, count(*) FILTER (b.ix IS NOT NULL) AS n FROM s CROSS JOIN a LEFT JOIN b ON b.ix = a.ix + dx AND b.iz = a.iz + dz GROUP BY 1, 2, 3), i AS (SELECT *, n / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b) - n) AS iou FROM c)
SELECT dx, dz, round(iou, 9) AS iou FROM i ORDER BY iou DESC, k LIMIT 1""")
def q_best_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    other = cells.where("v > 430").select((F.col("ix") + 1).alias("ix"), (F.col("iz") - 2).alias("iz"))
    return A.best_shift(cells.where("v > 420"), other, _SHIFTS).withColumn("iou", F.round("iou", 9))


# Each label's points in cells of 0.02, and the same turned by 37 degrees and moved; the search starts 3 degrees off, and a quarter turn.
def _align_sql(cell: float = 0.02, reach: int = 2) -> str:
    at = "CAST(floor({0} / 0.02::DOUBLE) AS BIGINT)".format
    c, s = "cos(radians(37.0::DOUBLE))", "sin(radians(37.0::DOUBLE))"
    parts = [
        f"own AS (SELECT DISTINCT label, ({at('x')} + 0.5::DOUBLE) * 0.02::DOUBLE AS x, ({at('z')} + 0.5::DOUBLE) * 0.02::DOUBLE AS z FROM plane)",
        f"oth AS (SELECT DISTINCT label, {at(f'(x * {c} - z * {s} + 0.05::DOUBLE)')} AS ix, {at(f'(x * {s} + z * {c} - 0.03::DOUBLE)')} AS iz FROM plane WHERE vec_id % 11 > 0)",
        "ctr AS (SELECT label, avg(ix + 0.5::DOUBLE) * 0.02::DOUBLE AS bx, avg(iz + 0.5::DOUBLE) * 0.02::DOUBLE AS bz, count(*) AS nb FROM oth GROUP BY 1), mean AS (SELECT label, avg(x) AS mx, avg(z) AS mz FROM own GROUP BY 1)",
        "pts AS (SELECT label, x - mx AS x, z - mz AS z, bx, bz, nb FROM own JOIN mean USING (label) JOIN ctr USING (label))",
    ]

    def step(name: str, candidates: str, stays: str) -> None:
        bx, bz = at("(bx + x * cos(radians(theta)) - z * sin(radians(theta)))"), at("(bz + x * sin(radians(theta)) + z * cos(radians(theta)))")
        parts.append(f"{name}c AS ({candidates})")
        parts.append(f"{name}t AS MATERIALIZED (SELECT DISTINCT label, k, theta, dx, dz, nb, {bx} + dx AS ix, {bz} + dz AS iz FROM pts JOIN {name}c USING (label))")
        parts.append(f"{name}s AS MATERIALIZED (SELECT label, k, theta, dx, dz, count(o.ix) / (count(*) + nb - count(o.ix)) AS iou FROM {name}t t LEFT JOIN oth o USING (label, ix, iz) GROUP BY label, k, theta, dx, dz, nb)")
        parts.append(f"{name} AS (SELECT label, theta, dx, dz, iou FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY iou DESC, CASE WHEN {stays} THEN 0 ELSE 1 END, k) AS r FROM {name}s) WHERE r = 1)")

    step("a0", "SELECT DISTINCT label, k, (34.0::DOUBLE + 90 + 90 * k + 180) % 360 - 180 AS theta, 0::BIGINT AS dx, 0::BIGINT AS dz FROM oth, range(0, 4) r(k)", "true")
    side = 2 * reach + 1
    for n in (0, 1):
        step(f"b{n}", f"SELECT label, k, theta + 0.5::DOUBLE * (k - 8) AS theta, dx, dz FROM {'a0' if n == 0 else 'm0'}, range(0, 17) r(k)", "k = 8")
        step(f"m{n}", f"SELECT label, k, theta, dx + k // {side} - {reach} AS dx, dz + k % {side} - {reach} AS dz FROM b{n}, range(0, {side * side}) r(k)", f"k = {side * side // 2}")
    parts.append("sec AS (SELECT label, list_sort(list(iou), 'DESC')[2] AS second FROM a0s GROUP BY label)")
    return f"""WITH {PLANE}, {", ".join(parts)} SELECT label, round(theta, 6) AS theta, dx, dz, round(iou, 9) AS iou, round(second, 9) AS second,
CASE WHEN iou > 0.8 AND iou - second > 0.1 THEN 'high' WHEN iou > 0.65 THEN 'medium' ELSE 'low' END AS confidence FROM m1 JOIN sec USING (label)"""


@query(_align_sql())
def q_turned_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = plane(spark, sf_dir)
    at = lambda v: F.floor(v / 0.02)
    c, s = F.cos(F.radians(F.lit(37.0))), F.sin(F.radians(F.lit(37.0)))
    own = points.select("label", ((at(F.col("x")) + 0.5) * 0.02).alias("x"), ((at(F.col("z")) + 0.5) * 0.02).alias("z")).distinct()
    other = points.where("vec_id % 11 > 0").select("label", at(F.col("x") * c - F.col("z") * s + 0.05).alias("ix"), at(F.col("x") * s + F.col("z") * c - 0.03).alias("iz"))
    base = points.select("label").distinct().withColumn("base", F.lit(124.0))
    found = aligned(own, other, "label", base, 0.02, 2)
    return found.select("label", F.round("theta", 6).alias("theta"), "dx", "dz", F.round("iou", 9).alias("iou"), F.round("second", 9).alias("second"), "confidence")


# A right-angled triangle a vector, with legs of 0.03, in the tilted plane of its label.
@query(f"""WITH {PLANE} SELECT a.vec_id AS a, b.vec_id AS b FROM plane a JOIN plane b ON a.label = b.label AND a.vec_id < b.vec_id AND greatest(a.x, b.x) + greatest(a.z, b.z) < 0.03::DOUBLE + least(a.x + a.z, b.x + b.z)""")
def q_coplanar_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = plane(spark, sf_dir)
    up = lambda x, z: F.col("label") * 2 + x * 0.4 - z * 0.7
    corners = {"a": (F.col("x"), F.col("z")), "b": (F.col("x") + 0.03, F.col("z")), "c": (F.col("x"), F.col("z") + 0.03)}
    triangles = points.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("owner"), *[c for p, (x, z) in corners.items() for c in (x.alias(f"{p}x"), up(x, z).alias(f"{p}y"), z.alias(f"{p}z"))])
    return faces.coplanar_overlaps(triangles, near=0.001, depth=0.0, cell=0.1)  # any overlap counts, as in the SQL


@query(f"""WITH {PLANE}, o AS (SELECT vec_id AS id, label, x, label % 2 * 0.01::DOUBLE + vec_id % 3 * 0.02::DOUBLE AS y, z FROM plane), p AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y)) AS d FROM o a JOIN o b ON a.label = b.label AND a.id < b.id)
SELECT a, b, round(d, 9) AS d FROM p WHERE d <= 0.04""")
def q_doubled_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = F.col("label") % 2 * 0.01 + F.col("vec_id") % 3 * 0.02
    return faces.doubled(plane(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", "x", height.alias("y"), "z"), "label", 0.04).withColumn("d", F.round("d", 9))


@query(f"""WITH {PLANE}, o AS (SELECT vec_id AS id, x, z, vec_id % 7 * 0.1::DOUBLE AS y, label * 0.05::DOUBLE AS h FROM plane WHERE vec_id % 2 = 0), t AS (SELECT x, z, vec_id % 5 * 0.1::DOUBLE AS top FROM plane WHERE vec_id % 2 = 1),
s AS (SELECT id, max(top) AS top FROM o JOIN t ON sqrt((o.x - t.x) * (o.x - t.x) + (o.z - t.z) * (o.z - t.z)) <= 0.03 AND top <= y + 0.15::DOUBLE GROUP BY 1)
SELECT id, round(y - greatest(h, top), 6) AS gap FROM o LEFT JOIN s USING (id) WHERE y - greatest(h, top) > 0.15""")
def q_floating_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = plane(spark, sf_dir)
    objects = points.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "x", "z", (F.col("vec_id") % 7 * 0.1).alias("y"), (F.col("label") * 0.05).alias("h"))
    supports = points.where("vec_id % 2 = 1").select("x", "z", (F.col("vec_id") % 5 * 0.1).alias("top"))
    return faces.floating(objects.drop("h"), supports, objects.select("id", "h"), 0.15, 0.03).withColumn("gap", F.round("gap", 6))


@query(f"""WITH {GRID}, m AS (SELECT avg(ix) AS mx, avg(iz) AS mz, avg(v) AS mv, covar_pop(ix, ix) AS xx, covar_pop(iz, iz) AS zz, covar_pop(ix, iz) AS xz, covar_pop(ix, v) AS xv, covar_pop(iz, v) AS zv FROM grid),
f AS (SELECT (xv * zz - zv * xz) / (xx * zz - xz * xz) AS a, (zv * xx - xv * xz) / (xx * zz - xz * xz) AS b, mx, mz, mv FROM m) SELECT round(max(abs(v - (mv + a * (ix - mx) + b * (iz - mz)))), 5) AS residual, count(*) AS n FROM grid, f""")
def q_affine_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return A.affine_residual(cells, A.affine_fit(cells, "ix", "iz", "v"), "ix", "iz", "v").withColumn("residual", F.round("residual", 5))


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hour, avg(value) AS temp, sum(value) AS rain FROM events GROUP BY 1, 2)
SELECT user_id, strftime(to_timestamp(epoch(hour)::BIGINT // 21600 * 21600)::TIMESTAMP, '%Y-%m-%d %H') AS step, count(*) AS dt, round(avg(temp), 5) AS temp, round(sum(rain), 5) AS rain FROM h GROUP BY 1, 2""")
def q_coarse_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp").alias("hour")).agg(F.avg("value").alias("temp"), F.sum("value").alias("rain"))
    steps = Q.coarse_steps(hours, ["user_id"], "hour", 6, ["temp"], ["rain"])
    return steps.select("user_id", F.date_format("step", "yyyy-MM-dd HH").alias("step"), "dt", F.round("temp", 5).alias("temp"), F.round("rain", 5).alias("rain"))


_CHANNEL = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END".format
_ROOT = "CASE WHEN {0} > 0.008856 THEN pow({0}, 1 / 3.0::DOUBLE) ELSE 7.787 * {0} + 16 / 116.0::DOUBLE END".format


@query(f"""WITH p AS (SELECT p_partkey, p_size * 5 AS r, p_partkey % 256 AS g, (p_partkey * 7) % 256 AS b FROM part), l AS (SELECT p_partkey, {_CHANNEL("r")} AS r, {_CHANNEL("g")} AS g, {_CHANNEL("b")} AS b FROM p),
x AS (SELECT p_partkey, (0.4124::DOUBLE * r + 0.3576::DOUBLE * g + 0.1805::DOUBLE * b) / 0.95047::DOUBLE AS x, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y, (0.0193::DOUBLE * r + 0.1192::DOUBLE * g + 0.9505::DOUBLE * b) / 1.08883::DOUBLE AS z FROM l),
f AS (SELECT p_partkey, {_ROOT("x")} AS x, {_ROOT("y")} AS y, {_ROOT("z")} AS z FROM x) SELECT p_partkey, round(116 * y - 16, 6) AS l, round(500 * (x - y), 6) AS a, round(200 * (y - z), 6) AS b FROM f""")
def q_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    light = S.lab(F.col("p_size") * 5, F.col("p_partkey") % 256, (F.col("p_partkey") * 7) % 256)
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(c, 6).alias(n) for c, n in zip(light, "lab")])


@query(f"""WITH {HULL_SQL}, v AS (SELECT DISTINCT label, ax AS x, az AS z FROM e), c AS (SELECT label, avg(x) AS cx, avg(z) AS cz FROM v GROUP BY 1), d AS (SELECT v.*, cx, cz, sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz)) AS d FROM v JOIN c USING (label))
SELECT label, round(cx + (x - cx) * ((d + 0.05::DOUBLE) / d), 8) AS x, round(cz + (z - cz) * ((d + 0.05::DOUBLE) / d), 8) AS z FROM d""")
def q_inflated_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    hull = M.hulls(plane(spark, sf_dir), "label")
    centres = hull.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("z").alias("cz"))
    x, z = G.inflated(F.col("x"), F.col("z"), F.col("cx"), F.col("cz"), 0.05)
    return hull.join(centres, "label").select("label", F.round(x, 8).alias("x"), F.round(z, 8).alias("z"))


@query("SELECT s_suppkey, CAST(i AS INTEGER) AS i, round(s_suppkey % 7 + (1 + s_suppkey % 3) * cos(i * (2 * pi() / 12)) + 1e-8::DOUBLE, 6) AS x, round(s_suppkey % 11 + (1 + s_suppkey % 3) * sin(i * (2 * pi() / 12)) + 1e-8::DOUBLE, 6) AS z FROM supplier, range(0, 12) r(i)")
def q_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    ring = G.circle((key % 7).cast("double"), (key % 11).cast("double"), (1 + key % 3).cast("double"), 12)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(ring).alias("i", "p")).select("s_suppkey", "i", *[F.round(F.col(f"p.{c}") + 1e-8, 6).alias(c) for c in "xz"])


@query("SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def q_stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = E.latest_result(E.sliding_totals(event_stream(spark, sf_dir), "user_id", "ts", "value", "1 hour", "1 hour"), "hours", ["user_id", "start"])
    return totals.select("user_id", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n", F.round("total", 3).alias("total"))


_MIRROR_EDGE = "CASE WHEN {0} < 0 THEN -({0}) - 1 WHEN {0} > 63 THEN 127 - ({0}) ELSE {0} END".format
_PICTURE = f"{GRID}, pic AS (SELECT ix, iz, v / 1000 AS a, (v + (ix * iz) % 7 * 9) / 1000 AS b FROM grid)"


def _picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("ix", "iz", (F.col("v") / 1000).alias("a"), ((F.col("v") + F.col("ix") * F.col("iz") % 7 * 9) / 1000).alias("b"))


def _kernel(weights: list[float]) -> str:
    reach = len(weights) // 2
    return "kern(d, w) AS (VALUES " + ", ".join(f"({k - reach}, {w!r}::DOUBLE)" for k, w in enumerate(weights)) + ")"


@query(f"""WITH {_PICTURE}, {_kernel(R.gaussian_weights(1.5))}, s AS (SELECT p.ix, p.iz, sum(i.w * j.w * q.a) AS ma, sum(i.w * j.w * q.b) AS mb, sum(i.w * j.w * q.a * q.a) AS aa, sum(i.w * j.w * q.b * q.b) AS bb, sum(i.w * j.w * q.a * q.b) AS ab
  FROM pic p CROSS JOIN kern i CROSS JOIN kern j JOIN pic q ON q.ix = {_MIRROR_EDGE("p.ix + i.d")} AND q.iz = {_MIRROR_EDGE("p.iz + j.d")} GROUP BY 1, 2)
SELECT round(avg((2 * ma * mb + 0.0001::DOUBLE) * (2 * (ab - ma * mb) + 0.0009::DOUBLE) / ((ma * ma + mb * mb + 0.0001::DOUBLE) * (aa - ma * ma + bb - mb * mb + 0.0009::DOUBLE))), 6) AS ssim, count(*) AS n FROM s""")
def q_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.similarity(_picture(spark, sf_dir), "a", "b").agg(F.round(F.avg("s"), 6).alias("ssim"), F.count("*").alias("n"))


@query(f"""WITH {GRID}, pic AS (SELECT ix, iz, CASE WHEN v > 430 THEN 1.0::DOUBLE ELSE 0 END AS a, (ix // 9 % 2)::DOUBLE AS b FROM grid), {_kernel([1 / 3] * 3)}, s AS (SELECT p.ix, p.iz, sum(i.w * j.w * q.a) AS ma, sum(i.w * j.w * q.a * q.a) AS aa, sum(i.w * j.w * q.b) AS mb, sum(i.w * j.w * q.b * q.b) AS bb
  FROM pic p CROSS JOIN kern i CROSS JOIN kern j JOIN pic q ON q.ix = {_MIRROR_EDGE("p.ix + i.d")} AND q.iz = {_MIRROR_EDGE("p.iz + j.d")} GROUP BY 1, 2) SELECT ix, iz FROM s WHERE greatest(aa - ma * ma, 0) + greatest(bb - mb * mb, 0) < 1e-7""")
def q_flat_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = grid(spark, sf_dir).select("ix", "iz", F.when(F.col("v") > 430, 1.0).otherwise(0.0).alias("a"), F.expr("CAST(ix div 9 % 2 AS DOUBLE)").alias("b"))
    return R.flat_cells(marks, ["a", "b"])


@query(f"""WITH {GRID}, m AS (SELECT avg(v) AS m FROM grid), f AS (SELECT ix, iz, (v - m) * (0.5 - 0.5 * cos(2 * pi() * ix / 63)) * (0.5 - 0.5 * cos(2 * pi() * iz / 63)) AS f FROM grid, m), k AS (SELECT k FROM range(0, 64) r(k)),
a AS (SELECT k AS u, iz, sum(f * cos(2 * pi() * k * ix / 64)) AS c, sum(f * sin(2 * pi() * k * ix / 64)) AS s FROM f, k GROUP BY 1, 2), b AS (SELECT u, k AS w, sum(c * cos(2 * pi() * k * iz / 64) - s * sin(2 * pi() * k * iz / 64)) AS re, sum(c * sin(2 * pi() * k * iz / 64) + s * cos(2 * pi() * k * iz / 64)) AS im FROM a, k GROUP BY 1, 2),
p AS (SELECT least(u, 64 - u) / 64::DOUBLE AS fx, least(w, 64 - w) / 64::DOUBLE AS fz, CASE WHEN u = 0 AND w = 0 THEN 0 ELSE re * re + im * im END AS p FROM b)
SELECT 1 AS image, round(sum(p) FILTER (sqrt(fx * fx + fz * fz) > 0.25) / sum(p), 6) AS high, round(sum(p) FILTER (fx > 0.42 OR fz > 0.42) / sum(p), 6) AS edge FROM p""")
def q_fine_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = R.fine_shares(grid(spark, sf_dir).withColumn("image", F.lit(1)), "image", "v")
    return shares.select("image", F.round("high", 6).alias("high"), F.round("edge", 6).alias("edge"))
