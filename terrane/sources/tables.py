"""Writing intermediate tables where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the setting is unset, one of this machine's in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="terrane-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back; iterations start from there. The files go when the session ends."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/terrane-{uuid.uuid4().hex}/{name}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path.getParent())
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def cut_counted(df: DataFrame, name: str = "table", of: Column | None = None) -> tuple[DataFrame, int]:
    """The same, and how many rows were written (or for how many ``of`` holds), counted on the way: no second job looks at the table.

    A task that runs again may count twice: the number is exact where it is 0, and else at least what it should be.
    """
    seen = Observation()
    counted = F.lit(1) if of is None else F.coalesce(of.cast("long"), F.lit(0))
    out = cut_lineage(df.observe(seen, F.coalesce(F.sum(counted), F.lit(0)).alias("n")), name)
    return out, int(seen.get["n"])
