"""Readers and writers of map, raster and log formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.ranks import numbered

_POINT = "struct<lat: double, lon: double>"
OSM = f"elements array<struct<type: string, id: long, lat: double, lon: double, tags: map<string, string>, geometry: array<{_POINT}>, members: array<struct<type: string, ref: long, role: string, geometry: array<{_POINT}>>>>>"


def osm_elements(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """One row an element of OSM JSON files: type, id, lat, lon, tags, geometry, members. ``one_line``: each line of a file is a document."""
    return spark.read.schema(OSM).json(path, multiLine=not one_line).select(F.inline("elements"))


def nodes_ways_members(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = elements.where("type = 'node'").select("id", "lat", "lon", "tags")
    ways = elements.where("type = 'way'").select("id", "tags", "geometry")
    members = elements.where("type = 'relation'").select(F.col("id").alias("relation"), "tags", F.posexplode_outer("members").alias("position", "m"))
    return nodes, ways, members.select("relation", "tags", "position", "m.type", "m.ref", "m.role", "m.geometry")


def geojson(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """kind, properties (a map) and geometry of each feature; coordinates stay JSON, whose depth goes with the geometry type.

    ``one_line``: each line of a file is a collection.
    """
    features = "features array<struct<properties: map<string, string>, geometry: string>>"
    rows = spark.read.schema(features).json(path, multiLine=not one_line).select(F.inline("features"))
    return rows.select("properties", F.col("properties")["kind"].alias("kind"), F.get_json_object("geometry", "$.type").alias("geometry_type"), F.get_json_object("geometry", "$.coordinates").alias("coordinates"))


def line_points(features: DataFrame, key: str) -> DataFrame:
    """key, i, x, z of the vertices of LineString features."""
    points = F.from_json("coordinates", "array<array<double>>")
    return features.where("geometry_type = 'LineString'").select(key, F.posexplode(points).alias("i", "_p")).select(key, "i", F.col("_p")[0].alias("x"), F.col("_p")[1].alias("z"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """One GeoJSON feature a line (properties a map, geometry_type and coordinates as read): files of any size, written in parallel."""
    one = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json("properties"), F.lit(',"geometry":{"type":"'), F.col("geometry_type"), F.lit('","coordinates":'), F.col("coordinates"), F.lit("}}"))
    features.select(one.alias("value")).write.text(path)


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """file, ts, model and token counts of JSON-lines session logs; malformed lines and lines without usage are left out."""
    usage = "struct<input_tokens: long, output_tokens: long, cache_creation_input_tokens: long, cache_read_input_tokens: long>"
    schema = f"timestamp string, message struct<model: string, usage: {usage}>, _corrupt string"
    rows = spark.read.schema(schema).json(path, columnNameOfCorruptRecord="_corrupt", mode="PERMISSIVE").withColumn("file", F.input_file_name())
    fine = rows.where("_corrupt IS NULL AND message.usage IS NOT NULL")
    return fine.select("file", F.col("timestamp").try_cast("timestamp").alias("ts"), "message.model", *[F.coalesce(f"message.usage.{c}", F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")])


def latest_session(log: DataFrame) -> DataFrame:
    """Totals of the session (file) with the newest entry, its first and last time and its last model."""
    counts = [c for c in log.columns if c.endswith("_tokens")]
    sessions = log.groupBy("file").agg(*[F.sum(c).alias(c) for c in counts], F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("model", "ts").alias("model"))
    return sessions.orderBy(F.desc("last"), "file").limit(1)


def log_lines(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """kind and line of text logs: the first of the patterns that a line matches, else ``other``."""
    kind = F.lit("other")
    for name, pattern in reversed(list(kinds.items())):
        kind = F.when(F.col("value").rlike(pattern), F.lit(name)).otherwise(kind)
    return spark.read.text(path).select(kind.alias("kind"), F.col("value").alias("line"))


def grid_cells(spark: SparkSession, path: str, nx: int, dtype: str = "<f4", band: int = 1 << 16) -> DataFrame:
    """file, iz, ix and v of raw row-major rasters with ``nx`` columns. A file is read once and leaves as cells in bands of rows.

    A file whose size isn't a whole number of rows is refused.
    """
    width = np.dtype(dtype).itemsize

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                if len(content) % (nx * width):
                    raise ValueError(f"{path}: {len(content)} bytes are no whole rows of {nx} cells")
                values = np.frombuffer(content, dtype)
                for begin in range(0, len(values), band):
                    at = np.arange(begin, min(begin + band, len(values)))
                    yield pd.DataFrame({"file": path, "iz": at // nx, "ix": at % nx, "v": values[at].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, iz int, ix int, v double")


def coded(cells: DataFrame, v: str, levels: int, name: str = "code") -> DataFrame:
    """Cells with whole codes 0..levels and the layer's offset and scale: v is about offset + code * scale."""
    bounds = cells.agg(F.min(v).alias("offset"), ((F.max(v) - F.min(v)) / levels).alias("scale"))  # one row
    code = F.when(F.col("scale") > 0, F.bround((F.col(v) - F.col("offset")) / F.col("scale"), 0)).otherwise(F.lit(0.0)).cast("int")
    return cells.crossJoin(F.broadcast(bounds)).withColumn(name, code)


def write_tiles(rows: DataFrame, x: str, z: str, size: float, path: str) -> None:
    """Parquet parted by square tiles, so that a window of the plane reads its tiles only."""
    tiled = rows.withColumns({"tile_x": F.floor(F.col(x) / size).cast("int"), "tile_z": F.floor(F.col(z) / size).cast("int")})
    tiled.repartition("tile_x", "tile_z").write.partitionBy("tile_x", "tile_z").parquet(path)


def read_window(spark: SparkSession, path: str, x: str, z: str, size: float, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Rows of a tiled table in x0 <= x < x1, z0 <= z < z1; tiles outside aren't opened."""
    x0, x1, z0, z1 = bounds
    tiles = F.col("tile_x").between(int(x0 // size), int(x1 // size)) & F.col("tile_z").between(int(z0 // size), int(z1 // size))
    return spark.read.parquet(path).where(tiles & (F.col(x) >= x0) & (F.col(x) < x1) & (F.col(z) >= z0) & (F.col(z) < z1))


# The fields of the records of two binary formats, trees and plants.
TREES = [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("rot", "<f4"), ("sx", "<f4"), ("sy", "<f4"), ("sz", "<f4"), ("r", "<f4"), ("g", "<f4"), ("b", "<f4"), ("proto", "<f4")]
PLANTS = [("kind", "<i4"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("rot", "<f4"), ("scale", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("aux", "u1")]


def records(spark: SparkSession, path: str, fields: list[tuple[str, str]], header: int = 0, batch: int = 1 << 16) -> DataFrame:
    """file, id (the record's number) and the fields of binary files of fixed records behind a header of so many bytes, in batches.

    A file whose rest isn't a whole number of records is refused.
    """
    kind = np.dtype(fields)
    whole = [name for name, code in fields if np.dtype(code).kind in "iu"]
    schema = "file string, id long, " + ", ".join(f"{name} {'long' if name in whole else 'double'}" for name, _ in fields)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                if len(content) < header or (len(content) - header) % kind.itemsize:
                    raise ValueError(f"{path}: {len(content)} bytes are no whole records of {kind.itemsize} behind {header}")
                rows = np.frombuffer(content, kind, offset=header)
                for begin in range(0, len(rows), batch):
                    part = rows[begin : begin + batch]
                    columns = {name: part[name].astype(np.int64 if name in whole else float) for name, _ in fields}
                    yield pd.DataFrame({"file": path, "id": np.arange(begin, begin + len(part)), **columns})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, schema)


def appended(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``rows`` and, behind them, ``more`` with the keys that follow the greatest one, in the order of its own keys."""
    top = rows.agg(F.coalesce(F.max(key), F.lit(-1)).alias("_top"))  # one row
    placed = numbered(more, [key]).crossJoin(F.broadcast(top)).withColumn(key, F.col("_top") + 1 + F.col("_at"))
    return rows.unionByName(placed.select(*rows.columns))


def catalogue(spark: SparkSession, path: str, schema: str, default: list[tuple] | None = None, lines: bool = False) -> DataFrame:
    """Rows of a JSON catalogue (with ``lines``, one a line); those of ``default`` where the path holds no file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if default is not None and not found:
        return spark.createDataFrame(default, schema)
    return spark.read.schema(schema).json(path, multiLine=not lines)


def write_metrics(rows: DataFrame, path: str) -> None:
    """CSV with a header and semicolons."""
    rows.write.option("header", True).option("sep", ";").csv(path)


def save_version(state: DataFrame, path: str, version: int) -> None:
    """A version of a table of state; one that is there already is an error."""
    state.write.json(f"{path}/version={version}")


def restore_latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the newest version: folders are listed, and no other version's files are read."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*")
    folders = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []
    versions = [int(f.getPath().getName().partition("=")[2]) for f in folders]
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path}/version={max(versions)}")
