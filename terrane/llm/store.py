"""Where intermediate tables live: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratches: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the setting is unset, one of this machine's in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="terrane-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs, and recoveries from lost executors, start there.

    The files go when the session ends, or the innermost ``scratch`` around the call; with ``keep``, the next one around that.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/terrane-{uuid.uuid4().hex}"
    path, files = _path(spark, folder)
    files.deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    around = _scratches[:-1] if keep else _scratches
    if around:
        around[-1].append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at its end: what is read later must have been written with ``keep``."""
    _scratches.append([])
    try:
        yield
    finally:
        for folder in _scratches.pop():
            path, files = _path(spark, folder)
            files.delete(path, True)
