"""Session builder and loader of the test tables."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Rows that executors hand to Python at a time: texts of some kilobytes make batches of some megabytes.
BATCH_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: their Python workers import it. Keep their batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="terrane-ship-")
        copy = shutil.copytree(root, f"{folder}/src/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", copy.rpartition("/")[0]))


def build_session(app: str = "terrane", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session pinned to UTC with adaptive execution; ``master`` only where it isn't given by spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
