"""Operators on small literal inputs whose results are derived by hand."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions import scalars as S
from terrane.operators import folds, graphs, land, multipolygons, quality, raster, relational, sequences, site_rules, spatial, stats
from terrane.sources import formats
from terrane.streaming import events


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def scalar(one, column):
    return one.select(column.alias("v")).first()["v"]


def test_scalars(one):
    lit = F.lit
    assert scalar(one, S.clamp(lit(7.0), 0.0, 5.0)) == 5.0
    assert scalar(one, S.smoothstep(0.0, 1.0, lit(0.5))) == 0.5
    assert scalar(one, S.in_wrapping_range(lit(23), 22, 6)) and not scalar(one, S.in_wrapping_range(lit(6), 22, 6))
    assert scalar(one, S.bit_flags([lit(True), lit(None).cast("boolean"), lit(True)])) == 5
    assert scalar(one, S.julian_day(lit("2024-01-01").cast("date"))) % 7 == 0
    assert scalar(one, S.easter(lit(2024))) == dt.date(2024, 3, 31)
    assert scalar(one, S.easter(lit(1954))) == dt.date(1954, 4, 18)
    assert scalar(one, S.easter(lit(1981))) == dt.date(1981, 4, 19)
    assert scalar(one, S.step_curve([(0, 1.0), (10, 2.0)], lit(10))) == 2.0
    assert scalar(one, S.linear_curve([(0, 0.0), (10, 5.0)], lit(4.0))) == 2.0
    assert scalar(one, S.linear_curve([(0, 0.0), (10, 5.0)], lit(40.0))) == 5.0
    assert scalar(one, S.cyclic_monthly([0.0] * 11 + [12.0], lit(0.0))) == pytest.approx(12 * 15 / 30.44)
    assert scalar(one, S.slug(lit("  Žďár nad Sázavou! "))) == "zdar-nad-sazavou"
    assert scalar(one, S.replace_longest_first(lit("Old Town Hall"), {"Town": "T", "Town Hall": "H"})) == "Old H"
    assert scalar(one, S.number_or_null(lit("1.5x"))) is None and scalar(one, S.number_or_null(lit("NaN"))) is None
    assert scalar(one, S.fill(lit("{a} and {b}"), {"a": lit("x"), "b": lit("y")})) == "x and y"
    assert scalar(one, S.quantise(lit(2.5), lit(0.0), lit(255.0))) == 2
    assert scalar(one, S.quantise(lit(3.0), lit(3.0), lit(3.0))) == 0
    code = (17 * 48271 + (2**32 - 1) % 2**31 * 69621 + 12345) % (2**31 - 1) * 16807 % (2**31 - 1)
    assert scalar(one, S.hash31(lit(2**32 - 1))) == code


def test_geometry(spark, one):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z")) for x, z in [(0, 0), (2, 0), (2, 1), (0, 1)]])
    assert scalar(one, G.ring_area(ring)) == 2.0
    assert scalar(one, F.size(G.open_ring(F.concat(ring, F.slice(ring, 1, 1))))) == 4
    lits = [F.lit(v) for v in (0.0, 1.0, -1.0, 0.0, 1.0, 0.0)]
    assert scalar(one, G.segment_distance(*lits)) == 1.0
    assert scalar(one, G.segment_distance(*[F.lit(v) for v in (3.0, 4.0, 0.0, 0.0, 0.0, 0.0)])) == 5.0
    x, z = G.azimuthal(F.lit(45.0), F.lit(0.0), 45.0, 0.0)
    assert scalar(one, x) == 0.0 and abs(scalar(one, z)) < 1e-6
    assert scalar(one, F.size(G.circle(F.lit(0.0), F.lit(0.0), F.lit(1.0), 8))) == 8


def test_relational(spark):
    members = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 1, None)], "k int, p int, v string")
    assert values(relational.assembled(members, ["k"], "p", "v", "s"), "k", "s") == [(1, "a b"), (2, "")]
    a, b = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "id int, v string")
    assert values(relational.first_source_wins([a, b], ["id"], [F.col("v")]), "id", "v") == [(1, "a"), (2, "b")]
    assert values(relational.replaced(b, a, ["id"]), "id", "v") == [(1, "a"), (2, "b")]
    coded = relational.encoded(spark.createDataFrame([("z",), ("a",), ("z",)], "k string"), "k")
    assert values(coded, "k", "code") == [("a", 0), ("z", 1), ("z", 1)]
    lines = relational.distinct_in_order(spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "line string, p int"), "line", "p")
    assert values(lines, "first_position", "label") == [(1, "2× x"), (2, "y")]
    assert relational.capped_in_proportion(a, "v", [F.col("id")], 10).count() == 1


def test_stats(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0)], "k int, x double")
    assert values(rows.groupBy("k").agg(F.percentile("x", F.lit(0.5)).alias("m")), "m") == [(2.5,)]
    assert values(stats.upper_medians(rows, ["k"], "x", "u", 4), "u") == [(3.0,)]
    ties = spark.createDataFrame([(1, 5), (1, 3), (1, None), (2, None)], "k int, v int")
    assert values(stats.mode_lowest(ties, ["k"], "v", "m", 255), "k", "m") == [(1, 3), (2, 255)]
    plane = spark.createDataFrame([(float(x), float(z), 2.0 * x - 3.0 * z + 1.0) for x in range(3) for z in range(3)], "x double, z double, u double")
    assert stats.affine_fit(plane, "x", "z", "u").first().asDict() == pytest.approx({"a": 2.0, "b": -3.0, "c": 1.0})
    models = spark.createDataFrame([(1, "flat", 1.0, 1), (1, "gable", 0.9, 4)], "k int, model string, e double, c int")
    assert values(stats.best_model(models, ["k"], "model", "e", "c", 0.1), "model") == [("flat",)]
    a, b = spark.range(0, 4).toDF("c"), spark.range(2, 6).toDF("c")
    assert stats.overlap_ratio(a, b, ["c"]).first()["iou"] == pytest.approx(1 / 3)
    assert stats.snapped_extent(plane, "x", "z", 0.5, 2.0).first().asDict() == {"x0": -1.5, "x1": 2.5, "z0": -1.5, "z1": 2.5}


def test_rasters(spark):
    cells = spark.createDataFrame([(x, z, float(10 - max(abs(x - 2), abs(z - 2)))) for x in range(5) for z in range(5)], "ix int, iz int, v double")
    assert values(raster.local_maxima(cells, "v"), "ix", "iz") == [(2, 2)]
    assert {(r["ix"], r["iz"]): r["s"] for r in raster.box_sum(cells.withColumn("v", F.lit(1.0)), "v", 1, "s").collect()}[(0, 0)] == 4.0
    assert all(r["m"] == 1.0 for r in raster.box_mean_clamped(cells.withColumn("v", F.lit(1.0)), "v", 2, "m").collect())
    flow = {(r["ix"], r["iz"]): (r["tx"], r["tz"]) for r in raster.steepest_descent(cells, "v").collect()}
    assert flow[(2, 2)] == (2, 1) and flow[(0, 0)] == (None, None)
    mask = cells.where("ix = 2 AND iz = 2").select("ix", "iz")
    assert raster.dilated(mask, 1, cells).count() == 9
    assert raster.opened(mask, 1, cells).count() == 0 and raster.opened(cells.select("ix", "iz"), 1, cells).count() == 25
    assert raster.block_mean(cells, "v", 2, 5, 5).count() == 4
    middle = spark.createDataFrame([(1, 1.5, 2.0), (2, 9.0, 9.0)], "k int, x double, z double")
    assert values(raster.bilinear(middle, "k", cells, "x", "z", "v", "v"), "k", "v") == [(1, 9.5)]
    assert values(raster.gathered(middle, cells, "x", "z", "v", "v"), "k", "v") == [(1, 10.0), (2, None)]


def test_spatial_joins_match_brute_force(spark):
    rng = np.random.default_rng(3)
    xy = rng.uniform(-1, 1, (120, 2)).round(3)
    points = spark.createDataFrame([(i, float(x), float(z)) for i, (x, z) in enumerate(xy)], "id long, x double, z double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    counts = {r["id"]: r["n"] for r in spatial.neighbour_counts(points, "id", 0.2).collect()}
    assert counts == {i: int((d[i] <= 0.2).sum()) - 1 for i in range(120)}
    few = points.where("id < 3").withColumnRenamed("id", "near")
    got = {r["id"]: r["near"] for r in spatial.nearest(points, "id", few, "near", 0.05).collect()}
    assert got == {i: int(d[i, :3].argmin()) for i in range(120)}
    square = [(1, i, *p) for i, p in enumerate([(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)])]
    edges = spark.createDataFrame([tuple([a, b, *map(float, c)]) for a, b, *c in square], "poly int, i int, x1 double, z1 double, x2 double, z2 double")
    inside = {r["id"] for r in spatial.points_in_polygons(points, "id", edges, "poly", 0.3).collect()}
    assert inside == {i for i, (x, z) in enumerate(xy) if 0 <= x < 1 and 0 <= z < 1}


def test_sequences(spark):
    ts = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rain = spark.createDataFrame([(1, ts(0)), (1, ts(6)), (1, ts(13))], "k int, ts timestamp")
    assert values(sequences.sessions(rain, ["k"], "ts", 6 * 3600).groupBy("session").count(), "session", "count") == [(1, 2), (2, 1)]
    assert values(sequences.filled_hours(rain, ["k"], "ts", 6).groupBy("dt").count(), "dt", "count") == [(1, 7), (7, 1)]
    events_ = spark.createDataFrame([(i, 1, ts(h)) for i, h in enumerate((0, 0.5, 1.0, 1.5, 3.0))], "id int, k int, ts timestamp")
    assert values(sequences.cooled_down(events_, ["k"], "ts", 3600, "id"), "id") == [(0,), (2,), (4,)]
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate((5, 1, 9, 2, 7))], "k int, i int, x double")
    assert [m for _, m in values(sequences.running_median(rows, ["k"], ["i"], "x"), "i", "median")] == [5.0, 5.0, 5.0, 7.0, 7.0]
    assert values(sequences.runs(rows, ["k"], ["i"], F.col("x") > 4).groupBy("run").count(), "run", "count") == [(1, 1), (2, 1), (3, 1)]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9), (6, 7), (8, 5)], "src long, dst long")
    assert values(graphs.component_labels(edges), "id", "component") == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5), (8, 5)]
    long_chain = spark.range(0, 200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graphs.component_labels(long_chain).select("component").distinct().collect()[0][0] == 0
    pointers = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 2)], "id long, next long")
    assert values(graphs.outlets(pointers), "id", "outlet")[0] == (1, 3)
    assert dict(values(graphs.outlets(pointers), "id", "outlet"))[6] == 3
    assert dict(values(graphs.outlets(pointers), "id", "outlet"))[4] is None
    flow = pointers.where("id NOT IN (4, 5)").withColumn("w", F.lit(1.0))
    assert dict(values(graphs.accumulated(flow, "w"), "id", "total")) == {1: 1.0, 2: 3.0, 3: 4.0, 6: 1.0}
    road = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0)], "src long, dst long, cost double")
    assert values(graphs.shortest_paths(road, spark.createDataFrame([(1,)], "id long")), "id", "cost") == [(1, 0.0), (2, 1.0), (3, 2.0)]


def test_outlets_of_long_chains_and_cycles(spark):
    chain = spark.range(0, 5000).select("id", (F.col("id") + 1).alias("next"))
    ring = spark.range(0, 7).select((F.col("id") + 10000).alias("id"), ((F.col("id") + 1) % 7 + 10000).alias("next"))
    tail = spark.createDataFrame([(20000, 10000)], "id long, next long")
    got = graphs.outlets(chain.unionByName(ring).unionByName(tail)).groupBy("outlet").count()
    assert {r["outlet"]: r["count"] for r in got.collect()} == {5000: 5000, None: 8}


def test_paths_end_where_nothing_is_left_to_reach(spark):
    chain = spark.range(0, 4).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("cost"))
    first = spark.range(1)
    assert dict(values(graphs.levels(chain, first, 4), "id", "hops")) == {i: i for i in range(5)}
    assert dict(values(graphs.shortest_paths(chain, first), "id", "cost")) == {i: float(i) for i in range(5)}
    for search in (graphs.levels, graphs.shortest_paths):
        with pytest.raises(ValueError):
            search(chain, first, 3)
    back = spark.createDataFrame([(0, 1, 1.0), (1, 0, -2.0)], "src long, dst long, cost double")
    with pytest.raises(ValueError):
        graphs.shortest_paths(back, first)


def test_quality(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(61)], "id int, v double")
    rules = [quality.Rule("big", F.when(F.col("v") == 60, "FAIL").otherwise("WARN"), -F.col("v"), F.lit("m")), quality.Rule("none", F.lit(None).cast("string"), F.col("v"), F.lit("m"))]
    found = quality.findings(rows, "id", rules)
    worst = quality.worst(found, "id", 50).orderBy("rank").collect()
    assert len(worst) == 50 and worst[0]["id"] == 60 and worst[1]["id"] == 0
    checks = spark.createDataFrame([("big", True), ("none", True), ("skipped", False)], "check string, ran boolean")
    status = quality.statuses(found, checks)
    assert values(status, "check", "status") == [("big", "FAIL"), ("none", "PASS"), ("skipped", "SKIP")]
    assert quality.overall(status).first()["status"] == "FAIL"
    assert quality.overall(status.where("status = 'SKIP'")).first()["status"] == "SKIP"


def test_folds(spark):
    series = spark.createDataFrame([(1, 0, 10.0), (1, 1, 10.0)], "k int, t int, v double")
    share = 1 - math.exp(-1)
    got = [x for _, x in values(folds.smoothed(series, "k", "t", "v", 0.0, 1.0, 1.0), "t", "smooth")]
    assert got == pytest.approx([10 * share, 10 * share + 10 * (1 - share) * share])
    square = spark.createDataFrame([(1, float(x), float(z)) for x in range(4) for z in range(4)], "k int, x double, z double")
    hull = folds.hulls(square, "k")
    assert {(r["x"], r["z"]) for r in hull.collect()} == {(0, 0), (3, 0), (3, 3), (0, 3)}
    box = folds.tightest_boxes(hull, "k").first()
    assert (box["length"], box["width"], box["cx"], box["cz"]) == pytest.approx((3, 3, 1.5, 1.5))
    ways = spark.createDataFrame([(1, 1, [1, 2, 3]), (1, 2, [5, 4, 3]), (1, 3, [5, 6, 1]), (1, 4, [8, 9])], "rel int, way int, nodes array<long>")
    assert [n for _, n in values(multipolygons.stitched(ways, ["rel"]), "i", "node")] == [1, 2, 3, 4, 5, 6]
    window = [(0.5, 0.0, 0.5, -1.0)]
    assert folds.clipped(hull, "k", window).agg(F.min("x")).first()[0] == 0.5


def test_streams_match_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 3, start + dt.timedelta(hours=7 * i), float(i)) for i in range(40)]
    batch = spark.createDataFrame(rows, "k long, ts timestamp, value double")
    batch.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    closed = events.run_once(events.day_close(stream(), "k", "ts", "value", 2, -1.0), "closed", "complete", f"{tmp_path}/c1")
    assert values(closed, "k", "day", "n", "mean") == values(events.day_close(batch, "k", "ts", "value", 2, -1.0), "k", "day", "n", "mean")
    tiles = events.run_once(events.decaying_tiles(stream(), "k", "ts", "value", 86400.0, 10 * 86400.0), "tiles", "update", f"{tmp_path}/c2")
    assert {r["k"] for r in tiles.where("level > 0").collect()} == {0, 1, 2}
    owed = spark.createDataFrame([(1, start, "debt", 10.0), (2, start, "debt", 5.0), (2, start + dt.timedelta(days=1), "paid", 5.0)], "k long, ts timestamp, kind string, amount double")
    owed.write.parquet(f"{tmp_path}/debts")
    debt = events.debts(spark.readStream.schema(owed.schema).parquet(f"{tmp_path}/debts"), "k", "ts", 3600, 7200, 1.0)
    got = values(events.run_once(debt, "debts", "update", f"{tmp_path}/c3"), "k", "status", "amount")
    assert (1, "open", 10.0) in got and (2, "paid", 5.0) in got


def test_formats(spark, tmp_path):
    osm = {"elements": [{"type": "node", "id": 1, "lat": 50.0, "lon": 15.0, "tags": {"natural": "tree"}}, {"type": "way", "id": 2, "tags": {"highway": "path"}, "geometry": [{"lat": 1, "lon": 2}]}, {"type": "relation", "id": 3, "members": [{"type": "way", "ref": 2, "role": "outer"}]}]}
    (tmp_path / "osm.json").write_text(json.dumps(osm))
    nodes, ways, members = formats.nodes_ways_members(formats.osm_elements(spark, f"{tmp_path}/osm.json"))
    assert (nodes.count(), ways.count(), members.first()["ref"]) == (1, 1, 2)
    geo = {"features": [{"type": "Feature", "properties": {"kind": "road"}, "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(geo))
    features = formats.geojson(spark, f"{tmp_path}/a.geojson")
    assert values(formats.line_points(features, "kind"), "i", "x", "z") == [(0, 0.0, 1.0), (1, 2.0, 3.0)]
    formats.write_geojson_lines(features, f"{tmp_path}/lines")
    assert json.loads(spark.read.text(f"{tmp_path}/lines").first()[0])["geometry"]["coordinates"] == [[0, 1], [2, 3]]
    log = [{"timestamp": "2024-01-01T00:00:00Z", "message": {"model": "m", "usage": {"input_tokens": 2, "output_tokens": 3}}}, {"timestamp": "x"}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, log)) + "\n{broken\n")
    last = formats.latest_session(formats.usage_log(spark, f"{tmp_path}/log.jsonl")).first()
    assert (last["input_tokens"], last["output_tokens"], last["model"]) == (2, 3, "m")
    np.arange(12, dtype="<f4").tofile(tmp_path / "g.bin")
    cells = formats.grid_cells(spark, f"{tmp_path}/g.bin", 4)
    assert values(cells.where("iz = 2"), "ix", "v") == [(i, 8.0 + i) for i in range(4)]
    assert formats.coded(cells, "v", 11).where("abs(offset + code * scale - v) > 0.5 * scale").count() == 0
    formats.write_tiles(cells, "ix", "iz", 2.0, f"{tmp_path}/tiles")
    assert formats.read_window(spark, f"{tmp_path}/tiles", "ix", "iz", 2.0, (1.0, 3.0, 0.0, 2.0)).count() == 4
    (tmp_path / "t.log").write_text("ERROR a\nb\n")
    assert values(formats.log_lines(spark, f"{tmp_path}/t.log", {"error": "^ERROR"}), "kind") == [("error",), ("other",)]


def test_folds_of_a_long_series(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("k"), "id", F.lit(1.0).alias("v"))
    out = folds.bounded_state(rows, "k", "id", "v", 0.0, float(n))
    assert out.agg(F.count("*"), F.max("state"), F.sum((F.col("state") != F.col("id") + 1).cast("int"))).first()[:] == (n, float(n), 0)
    nulls = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (1, 2, 1.0), (9, 0, 5.0)], "k int, o int, v double")
    assert values(folds.bounded_state(nulls, "k", "o", "v", 0.0, 9.0), "k", "o", "state") == [(1, 0, 2.0), (1, 1, 2.0), (1, 2, 3.0), (9, 0, 5.0)]
    assert folds.bounded_state(nulls.limit(0), "k", "o", "v").count() == 0


def test_chains_of_any_length(spark):
    n = 5000
    chain = spark.range(n).select("id", F.when(F.col("id") + 1 < n, F.col("id") + 1).alias("next"), F.lit(1.0).alias("w"))
    assert graphs.outlets(chain).agg(F.count("*"), F.min("outlet"), F.max("outlet")).first()[:] == (n - 1, n - 1, n - 1)
    assert graphs.accumulated(chain, "w").where(F.col("total") != F.col("id") + 1).count() == 0
    line = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert values(graphs.levels(line, spark.range(1)), "id", "hops") == [(k, k) for k in range(41)]
    loop = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 2, 1.0), (4, None, 1.0), (5, 4, 2.0)], "id long, next long, w double")
    assert values(graphs.accumulated(loop, "w"), "id", "total") == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 3.0), (5, 2.0)]


def test_medians_of_ranges(spark):
    rows = spark.createDataFrame([(k % 3, float((k * 37) % 101)) for k in range(300)] + [(7, 1.0), (7, None)], "k int, x double")
    own = {k: sorted(float((i * 37) % 101) for i in range(300) if i % 3 == k) for k in range(3)}
    assert values(stats.upper_medians(rows, ["k"], "x"), "k", "upper") == sorted([(k, v[len(v) // 2]) for k, v in own.items()] + [(7, None)])


def test_records_catalogues_and_versions(spark, tmp_path):
    kind = np.dtype(formats.TREES)
    rows = np.zeros(5, kind)
    rows["x"], rows["proto"] = range(5), 7
    (tmp_path / "trees").mkdir()
    (tmp_path / "trees" / "a.bin").write_bytes(b"HEAD" + rows.tobytes())
    trees = formats.records(spark, str(tmp_path / "trees"), formats.TREES, 4, batch=2)
    assert values(trees, "id", "x", "proto") == [(i, float(i), 7.0) for i in range(5)]
    more = spark.createDataFrame([(3, 9.0), (1, 8.0)], "id long, x double")
    assert values(formats.appended(trees.select("id", "x"), more, "id"), "id", "x")[4:] == [(4, 4.0), (5, 8.0), (6, 9.0)]
    assert values(formats.appended(trees.select("id", "x").limit(0), more, "id"), "id", "x") == [(0, 8.0), (1, 9.0)]
    with pytest.raises(Exception, match="no whole records"):
        formats.records(spark, str(tmp_path / "trees"), formats.TREES, 3).count()
    none = formats.catalogue(spark, str(tmp_path / "none.json"), "id int, name string", [(1, "a")])
    assert values(none, "id", "name") == [(1, "a")]
    (tmp_path / "some.json").write_text('[{"id": 2, "name": "b"}]')
    assert values(formats.catalogue(spark, str(tmp_path / "some.json"), "id int, name string", []), "id", "name") == [(2, "b")]
    state = spark.createDataFrame([(1, "x")], "k int, v string")
    formats.save_version(state, str(tmp_path / "saves"), 3)
    formats.save_version(state.withColumn("v", F.lit("y")), str(tmp_path / "saves"), 12)
    assert values(formats.restore_latest(spark, str(tmp_path / "saves"), "k int, v string"), "k", "v") == [(1, "y")]
    formats.write_metrics(state, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), sep=";", header=True).first()["v"] == "x"


def test_land_cases(spark):
    cells = spark.createDataFrame([(x, z, 10.0) for x in range(6) for z in range(6)], "ix int, iz int, v double")
    assert {r["m"] for r in land.box_mean_reflected(cells, "v", 2, "m").collect()} == {10.0}
    block = spark.createDataFrame([(2, 2, 20.0)], "ix int, iz int, v double")
    got = {(r["ix"], r["iz"]): r["v"] for r in land.feathered(cells, block, "v", 2).collect()}
    assert len(got) == 36 and got[2, 2] == 20.0 and got[2, 1] == 20.0 and got[2, 0] == 15.0 and got[5, 5] == 10.0
    mask = spark.createDataFrame([(0, 0), (0, 1), (3, 3), (-2, 5)], "ix int, iz int")
    assert values(land.areas(mask), "n", "x0", "x1", "z0", "z1") == [(1, -2, -2, 5, 5), (1, 3, 3, 3, 3), (2, 0, 0, 0, 1)]
    assert land.areas(mask.limit(0)).count() == 0


def test_boxes_of_all_sizes_and_long_segments(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        x, z, w, h = *rng.uniform(-50, 50, 2), *(10.0 ** rng.uniform(-2, 2, 2))
        rows.append((i, float(x), float(x + w), float(z), float(z + h)))
    boxes = spark.createDataFrame(rows, "id int, x0 double, x1 double, z0 double, z1 double")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] < b[2] and b[1] < a[2] and a[3] < b[4] and b[3] < a[4])
    assert values(spatial.overlapping_boxes(boxes, "id", 0.5), "a", "b") == want
    lines = [(k, *map(float, rng.uniform(-40, 40, 4))) for k in range(12)] + [(12, 3.0, -40.0, 3.0, 40.0), (13, -40.0, 5.0, 40.0, 5.0), (14, 1.0, 1.0, 1.0, 1.0)]
    points = [(k, *map(float, rng.uniform(-45, 45, 2))) for k in range(300)]
    got = spatial.nearest_segment(spark.createDataFrame(points, "id int, x double, z double"), "id", spark.createDataFrame(lines, "seg int, x1 double, z1 double, x2 double, z2 double"), "seg", 3.0)

    def far(p, s):
        d = np.array([s[3] - s[1], s[4] - s[2]])
        t = min(max(float(np.dot([p[1] - s[1], p[2] - s[2]], d) / max(d @ d, 1e-300)), 0), 1)
        return float(np.hypot(p[1] - s[1] - t * d[0], p[2] - s[2] - t * d[1]))

    best = {p[0]: min((far(p, s), s[0]) for s in lines) for p in points}
    assert values(got, "id", "seg") == sorted((k, s) for k, (d, s) in best.items() if d <= 3)
    cells = spatial._segment_cells(spark.createDataFrame([(0.0, 0.0, 500.0, 500.0)], "x1 double, z1 double, x2 double, z2 double"), 1.0, 1.0).count()
    assert cells < 4000


def test_rules_on_a_small_town(spark):
    B = site_rules
    shape = "id long, kind string, shape string, ground double, eave double, ridge double, dir_x double, dir_z double, ridge_x double, ridge_z double, door_x double, door_z double"
    rows = [(1, "house", "gable", 0.0, 5.0, 8.0, 1.0, 0.0, 5.0, 5.0, 5.0, 0.0), (2, "shed", "flat", 0.0, 13.0, 14.0, 1.0, 0.0, None, None, None, None), (3, "hut", "gable", 2.0, 1.0, 1.0, 1.0, 0.0, 40.0, 40.0, 40.0, 47.0), (4, "house", "gable", 0.0, 5.0, 9.0, 1.0, 0.0, 90.0, 5.0, 5.0, -3.0)]
    houses = spark.createDataFrame(rows, shape)
    square = lambda k, x, z, a: [(k, 0, x, z, x + a, z), (k, 1, x + a, z, x + a, z + a), (k, 2, x + a, z + a, x, z + a), (k, 3, x, z + a, x, z)]
    rings = [e for k, x, z in ((1, 0.0, 0.0), (2, 5.0, 0.0), (3, 35.0, 35.0), (4, 0.0, 0.0)) for e in square(k, x, z, 10.0)]
    edges = spark.createDataFrame(rings, "id long, i int, x1 double, z1 double, x2 double, z2 double")
    found = lambda df: sorted((r["check"], r["severity"], r["id"]) for r in df.collect())
    assert found(B.wall_heights(houses, edges)) == [("order", "FAIL", 3), ("wall", "FAIL", 2)]
    assert found(B.roofs(houses, edges)) == [("roof_beside", "WARN", 4), ("roof_flat", "WARN", 2)]
    over = B.overlaps(edges).collect()
    assert sorted((r["id"], r["other"], r["severity"], round(r["score"])) for r in over) == [(1, 2, "FAIL", 50), (1, 4, "FAIL", 100), (2, 4, "FAIL", 50)]
    roads = spark.createDataFrame([(0, "residential", 4.0, True, 0, -20.0, -1.0, 30.0, -1.0), (1, "footway", 2.0, False, 0, 30.0, 40.0, 60.0, 40.0)], "road int, kind string, width double, drivable boolean, i int, x1 double, z1 double, x2 double, z2 double")
    hit = B.buildings_on_roads(edges, roads, 2.0).collect()
    assert sorted((r["id"], r["severity"], round(r["score"]), r["drivable"]) for r in hit) == [(1, "WARN", 10, True), (2, "WARN", 10, True), (3, "WARN", 20, False), (4, "WARN", 10, True)]
    axis = spark.createDataFrame([(0, k, float(x), -20.0) for k, x in enumerate(range(-20, 31))], "road int, i int, x1 double, z1 double")
    assert found(B.doors(houses, edges, axis, 4.0)) == [("door_away", "WARN", 3), ("door_off", "FAIL", 4), ("door_off", "WARN", 3)]
    none, no_edges, no_roads = houses.limit(0), edges.limit(0), roads.limit(0)
    assert B.wall_heights(none, no_edges).count() == B.roofs(none, no_edges).count() == B.overlaps(no_edges).count() == B.buildings_on_roads(no_edges, roads, 2.0).count() == B.buildings_on_roads(edges, no_roads, 2.0).count() == 0
    assert B.road_clashes(edges, roads, {"residential": 2.0}, {"residential": 5.0}).count() == 3
    flat = spark.createDataFrame([(0, True, k, 2.0 * k, 0.0 if k < 6 else 1.6, 3.0, 0.0, 1.5) for k in range(12)], "road int, drivable boolean, k int, s double, h double, width double, left double, right double")
    assert found(B.road_steps(flat)) == [("step", "FAIL", 0)] and found(B.road_grades(flat, 5, 2.0)) == [("grade", "INFO", 0)] and found(B.road_crossfalls(flat)) == [("crossfall", "FAIL", 0)]
