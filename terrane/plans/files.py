"""Queries: tables written in a format to the shared folder and read again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.plans.registry import Registry
from terrane.plans.space import PLANE, plane
from terrane.plans.statistics import GRID, grid
from terrane.session import table
from terrane.sources import formats as O
from terrane.sources import layers
from terrane.sources.tables import shared_dir

registry = Registry()
query = registry.query


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that goes when the session ends."""
    where = f"{shared_dir(spark)}/terrane-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{where}/{name}"


@query("""SELECT event_type AS model, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN user_id % 2 = 0 THEN user_id ELSE 0 END) AS BIGINT) AS output_tokens FROM events WHERE event_id % 7 > 0 GROUP BY 1""")
def q_usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = F.struct((F.col("event_id") % 100).alias("input_tokens"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("output_tokens"))
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.struct(F.col("event_type").alias("model"), usage.alias("usage")).alias("message"))
    line = F.when(F.col("event_id") % 7 > 0, F.to_json(entry)).when(F.col("event_id") % 14 == 0, "{broken").otherwise('{"type": "other"}')
    where = _folder(spark, "log")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(where)
    log = O.usage_log(spark, where)
    return log.groupBy("model").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query(f"WITH {PLANE} SELECT vec_id, CAST(i AS INTEGER) AS i, round(x + i * 0.5::DOUBLE, 9) AS x, round(z - i::DOUBLE, 9) AS z FROM plane, range(0, 3) r(i) WHERE vec_id % 3 > 0")
def q_geojson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.array(F.col("x") + i * 0.5, F.col("z") - i) for i in range(3)])
    kind = F.when(F.col("vec_id") % 3 > 0, "LineString").otherwise("Polygon")
    geometry = F.struct(kind.alias("type"), pairs.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("road").alias("kind"), F.col("vec_id").cast("string").alias("id")).alias("properties"), geometry.alias("geometry"))
    files = plane(spark, sf_dir).select(feature.alias("f"), F.floor(F.col("vec_id") / 1000).alias("file")).groupBy("file").agg(F.collect_list("f").alias("features"))  # 1000 features a document
    where = _folder(spark, "geojson")
    files.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.text(where)
    lines = O.geojson(spark, where, one_line=True).withColumn("vec_id", F.col("properties")["id"].cast("long"))
    return O.line_points(lines, "vec_id").select("vec_id", "i", F.round("x", 9).alias("x"), F.round("z", 9).alias("z"))


@query("""SELECT o_custkey AS relation, o_orderkey AS ref, CASE WHEN o_orderkey % 3 = 0 THEN 'inner' ELSE 'outer' END AS role, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS position, o_orderpriority AS surface
FROM orders WHERE o_custkey % 10 = 0""")
def q_osm_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_custkey % 10 = 0")
    way = F.struct(F.lit("way").alias("type"), F.col("o_orderkey").alias("id"), F.create_map(F.lit("surface"), F.col("o_orderpriority")).alias("tags"))
    member = F.struct(F.lit("way").alias("type"), F.col("o_orderkey").alias("ref"), F.when(F.col("o_orderkey") % 3 == 0, "inner").otherwise("outer").alias("role"))
    by = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(member)).alias("members"), F.collect_list(F.to_json(way)).alias("ways"))
    relation = F.to_json(F.struct(F.lit("relation").alias("type"), F.col("o_custkey").alias("id"), "members"))
    where = _folder(spark, "osm")
    by.select(F.concat(F.lit('{"elements":['), F.array_join(F.concat("ways", F.array(relation)), ","), F.lit("]}")).alias("value")).write.text(where)
    nodes, ways, members = O.nodes_ways_members(O.osm_elements(spark, where, one_line=True))
    tagged = ways.select(F.col("id").alias("ref"), F.col("tags")["surface"].alias("surface"))
    return members.join(tagged, "ref").select("relation", "ref", "role", "position", "surface")


@query(f"WITH {PLANE} SELECT vec_id, round(x, 9) AS x, round(z, 9) AS z FROM plane WHERE x >= -0.12 AND x < 0.13 AND z >= -0.2 AND z < 0.01")
def q_tile_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _folder(spark, "tiles")
    O.write_tiles(plane(spark, sf_dir), "x", "z", 0.1, where)
    return O.read_window(spark, where, "x", "z", 0.1, (-0.12, 0.13, -0.2, 0.01)).select("vec_id", F.round("x", 9).alias("x"), F.round("z", 9).alias("z"))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM customer")
def q_saved_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, rows = _folder(spark, "saves"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    O.save_version(rows.withColumn("state", F.lit("old")), where, 9)
    O.save_version(rows.withColumn("state", F.when(F.col("c_custkey") % 2 == 0, "new").otherwise("old")), where, 10)
    return O.restore_latest(spark, where, "c_custkey long, c_name string, state string")


@query("SELECT p_partkey, p_name, round(p_retailprice, 4) AS price FROM part")
def q_metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _folder(spark, "csv")
    O.write_metrics(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.round("p_retailprice", 4).alias("price")), where)
    return spark.read.schema("p_partkey long, p_name string, price double").option("header", True).option("sep", ";").csv(where)


@query("""SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey), c_name FROM customer""")
def q_appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    more = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return O.appended(rows, more, "id")


def _layer(rows: DataFrame, order: list[str], name: str, fields: list[tuple[str, str]]) -> DataFrame:
    """Rows written as a binary layer in this order, and read again in ranges of 1000 records."""
    spark = rows.sparkSession
    layers.register(spark)
    options = {"path": _folder(spark, name), "fields": json.dumps(fields), "split": "1000"}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.format("layer").options(**options).mode("append").save()
    return spark.read.format("layer").options(**options).load()


@query(f"WITH {GRID} SELECT CAST(ix AS BIGINT) AS ix, CAST(iz AS BIGINT) AS iz, CAST(CAST(v / 7 AS FLOAT) AS DOUBLE) AS v FROM grid")
def q_raster_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    nx, cells = 64, grid(spark, sf_dir)
    whole = spark.range(nx * nx).select(F.expr(f"CAST(id div {nx} AS INT) AS iz"), F.expr(f"CAST(id % {nx} AS INT) AS ix")).join(cells, ["ix", "iz"], "left")
    layer = _layer(whole.select("iz", "ix", (F.coalesce("v", F.lit(-7.0)) / 7).alias("v")), ["iz", "ix"], "raster", [("v", "<f4")])
    return layer.where("v >= 0").select(F.expr(f"id % {nx} AS ix"), F.expr(f"id div {nx} AS iz"), "v")


@query("""SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS x, CAST(p_size AS BIGINT) AS kind, p_partkey % 256 AS r FROM part""")
def q_record_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [("kind", "<i4"), ("x", "<f4"), ("r", "u1")]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").alias("kind"), (F.col("p_partkey") % 256).alias("r"))
    return _layer(rows, ["p_partkey"], "records", fields).select("id", "x", "kind", "r")


@query(f"WITH {GRID}, b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 65535 AS step FROM grid) SELECT ix, iz, round(lo + round_even((v - lo) / step, 0) * step, 6) AS v FROM grid, b")
def q_coded_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = O.coded(grid(spark, sf_dir), "v", 65535)
    bounds = coded.select("offset", "scale").limit(1)  # all rows have the same
    layer = _layer(coded.select("ix", "iz", "code"), ["ix", "iz"], "coded", [("ix", "<i2"), ("iz", "<i2"), ("code", "<u2")])
    return layer.crossJoin(F.broadcast(bounds)).select(F.col("ix").cast("int").alias("ix"), F.col("iz").cast("int").alias("iz"), F.round(F.col("offset") + F.col("code") * F.col("scale"), 6).alias("v"))


@query("SELECT c_custkey, c_name AS name, round(c_acctbal, 2) AS x, CAST(c_nationkey AS DOUBLE) AS z FROM customer")
def q_geojson_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _folder(spark, "features")
    at = F.to_json(F.array(F.round("c_acctbal", 2), F.col("c_nationkey").cast("double")))
    properties = F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("name"), F.col("c_name"))
    O.write_geojson_lines(table(spark, sf_dir, "customer").select(properties.alias("properties"), F.lit("Point").alias("geometry_type"), at.alias("coordinates")), where)
    lines = spark.read.schema("type string, properties map<string, string>, geometry struct<type: string, coordinates: array<double>>").json(where)
    return lines.where("type = 'Feature' AND geometry.type = 'Point'").select(F.col("properties")["id"].cast("long").alias("c_custkey"), F.col("properties")["name"].alias("name"), F.col("geometry.coordinates")[0].alias("x"), F.col("geometry.coordinates")[1].alias("z"))


@query("""WITH c AS (SELECT p_brand, count(*) AS kinds, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1 HAVING count(*) % 2 = 0) SELECT p_partkey, coalesce(kinds, -1) AS kinds, coalesce(price, 0) AS price FROM part LEFT JOIN c USING (p_brand)""")
def q_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, parts = _folder(spark, "catalogue"), table(spark, sf_dir, "part")
    brands = parts.groupBy("p_brand").agg(F.count("*").alias("kinds"), F.round(F.avg("p_retailprice"), 4).alias("price")).where("kinds % 2 = 0")
    brands.select(F.to_json(F.struct("*")).alias("value")).write.text(where)
    found = O.catalogue(spark, where, "p_brand string, kinds long, price double", lines=True)
    missing = O.catalogue(spark, f"{where}-none", "p_brand string, kinds long, price double", [("none", -1, 0.0)]).select(F.col("kinds").alias("_k"), F.col("price").alias("_p"))
    return parts.join(found, "p_brand", "left").crossJoin(F.broadcast(missing)).select("p_partkey", F.coalesce("kinds", "_k").alias("kinds"), F.coalesce("price", "_p").alias("price"))  # a row of defaults
