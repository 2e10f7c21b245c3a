"""What the rules on sites send through the driver."""

import re

import pytest

from terrane.operators import site_rules

ROAD = [(1, "residential", 5.5, True, 0, -5.0, 3.0, 500.0, 3.0)]
SEGMENT = "road int, kind string, width double, drivable boolean, i int, x1 double, z1 double, x2 double, z2 double"


@pytest.fixture
def footprints(spark, tmp_path):
    """Edges of 50 square footprints in a small file: 320,000 points, that Spark takes for a few kilobytes."""
    ring = [(0, 0), (20, 0), (20, 20), (0, 20)]
    rows = [(k, i, 30.0 * k + x1, float(z1), 30.0 * k + x2, float(z2)) for k in range(50) for i, ((x1, z1), (x2, z2)) in enumerate(zip(ring, ring[1:] + ring[:1]))]
    spark.createDataFrame(rows, "id long, i int, x1 double, z1 double, x2 double, z2 double").coalesce(1).write.parquet(f"{tmp_path}/edges")
    return spark.read.parquet(f"{tmp_path}/edges")


def sent_by_cell(found):
    """Broadcast joins by cell whose left side, the points, goes through the driver."""
    return re.findall(r"BroadcastHashJoin \[_cx[^\n]*BuildLeft", found._jdf.queryExecution().sparkPlan().toString())


def test_points_of_clashes_are_not_broadcast(spark, footprints):
    found = site_rules.road_clashes(footprints, spark.createDataFrame(ROAD, SEGMENT), {"residential": 2.5}, {"residential": 1.0})
    assert not sent_by_cell(found)
    rows = {r["id"]: (r["kind"], r["m2"]) for r in found.collect()}
    assert rows.keys() == set(range(17)) and all(rows[k] == ("residential", 100.0) for k in range(16))


def test_points_on_roads_are_not_broadcast(spark, footprints):
    found = site_rules.buildings_on_roads(footprints, spark.createDataFrame(ROAD, SEGMENT), 3.0)
    assert not sent_by_cell(found)
    rows = {r["id"]: (r["severity"], r["score"], r["depth"]) for r in found.collect()}
    assert rows.keys() == set(range(17)) and all(rows[k] == ("FAIL", 22 * 0.25 * 20, 2.625) for k in range(16))
