"""Binary layers written and read again, in ranges of records."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.sources import layers
from terrane.sources.formats import PLANTS, TREES

FIELDS = [("v", "<f4"), ("code", "u1"), ("n", "<i4")]


def options(path, fields=FIELDS, **more):
    return {"path": str(path), "fields": json.dumps(fields)} | {k: str(v) for k, v in more.items()}


def test_round_trip_in_ranges(spark, tmp_path):
    layers.register(spark)
    rows = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") / 7).alias("v"), (F.col("id") % 256).alias("code"), (-F.col("id") * 1000).alias("n"))
    rows.repartitionByRange(5, "key").sortWithinPartitions("key").write.format("layer").options(**options(tmp_path / "a")).mode("append").save()
    got = spark.read.format("layer").options(**options(tmp_path / "a", split=300)).load()
    assert got.rdd.getNumPartitions() >= 15
    frame = got.toPandas().sort_values("id")
    assert frame["id"].tolist() == list(range(5000))
    assert (frame["v"].to_numpy() == (np.arange(5000) / 7).astype("<f4").astype(float)).all()
    assert frame["code"].tolist() == [k % 256 for k in range(5000)] and frame["n"].tolist() == [-1000 * k for k in range(5000)]
    with pytest.raises(Exception, match="holds a layer already"):
        rows.write.format("layer").options(**options(tmp_path / "a")).mode("append").save()
    with pytest.raises(Exception, match="don't fit"):
        rows.withColumn("code", F.lit(300)).write.format("layer").options(**options(tmp_path / "b")).mode("append").save()


def test_files_from_elsewhere_with_headers(spark, tmp_path):
    layers.register(spark)
    for fields, name in ((TREES, "trees"), (PLANTS, "plants")):
        kind = np.dtype(fields)
        made = np.zeros(700, kind)
        for k, (field, _) in enumerate(fields):
            made[field] = np.arange(700) % 100 + k
        folder = tmp_path / name
        folder.mkdir()
        for k in range(2):
            (folder / f"{k}.bin").write_bytes(b"HEAD" + made[350 * k : 350 * (k + 1)].tobytes())
        got = spark.read.format("layer").options(**options(folder, fields, header=4, split=64)).load().toPandas().sort_values("id")
        for field, _ in fields:
            assert (got[field].to_numpy() == made[field].astype(float)).all()
    (tmp_path / "bad.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="no whole records"):
        spark.read.format("layer").options(**options(tmp_path / "bad.bin")).load().count()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("layer").options(**options(tmp_path / "empty")).load().count() == 0
    with pytest.raises(Exception, match="share"):
        spark.read.format("layer").options(**options("s3://x/y")).load().count()
