"""Places and quantiles at few and many partitions, on more rows than Spark's sample of a partition holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import ranks, relational
from terrane.sources import formats


@pytest.fixture(params=[2, 4, 200])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_places_are_gapless(spark, partitions):
    rows = spark.range(30_000).select((F.hash("id") % 500).alias("x"), F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 2 == 0, 2).alias("g"), "id")
    got = ranks.numbered(rows, ["x"], ["g"]).toPandas()
    assert len(got) == got["id"].nunique() == 30_000
    for _, group in got.groupby("g", dropna=False):
        group = group.sort_values("_at")
        assert group["_at"].tolist() == list(range(len(group))) and (group["_all"] == len(group)).all()
        assert group["x"].is_monotonic_increasing


def test_quantiles(spark, partitions):
    rng = np.random.default_rng(1)
    values = {1: rng.normal(0, 1, 5000), 2: np.repeat(3.0, 4000), 3: np.array([7.0]), 4: np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [(1, None), (5, None)]
    got = ranks.quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()
    assert {r["g"] for r in got} == set(values)
    for r in got:
        np.testing.assert_allclose([r["low"], r["mid"], r["top"]], np.quantile(values[r["g"]], [0.1, 0.5, 1.0]), atol=1e-12)


def test_users_of_places(spark, partitions):
    more = spark.range(12_000).select((F.col("id") * 7).alias("id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    rows = spark.createDataFrame([(41, "a"), (3, "b")], "id long, name string")
    got = formats.appended(rows, more, "id").toPandas()
    new = got[got["id"] > 41].sort_values("id")
    assert new["id"].tolist() == list(range(42, 12_042)) and new["name"].tolist() == [f"n{i}" for i in range(12_000)]
    codes = relational.encoded(more.unionByName(more), "id").toPandas()
    assert len(codes) == 24_000 and (codes["code"] * 7 == codes["id"]).all()
    assert formats.appended(rows.limit(0), more.limit(3), "id").count() == 3
