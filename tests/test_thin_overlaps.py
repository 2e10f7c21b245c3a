"""Faces that overlap by next to nothing, against the SQL."""

import pytest

from terrane.operators import faces
from terrane.plans import catalogue
from tests.test_faces import pairs, triangles


def test_overlaps_of_under_a_billionth(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    places = [(0.0, 0.0)]
    for far in (1e-8, 1e-9, 5e-10, 1e-11):  # over and under a leg of 0.03 along either axis, and along the third side
        for leg in (0.03 - far, 0.03 + far):
            places += [(leg, -1.0), (leg / 2, leg / 2 - 1.0), (0.0, leg - 1.0)]
    places.append((0.0, -1.0))
    rows = [(k, k // 7 % 2 + 8, [x, z]) for k, (x, z) in enumerate(places)] + [(100 + k, 9, [x, z]) for k, (x, z) in enumerate(places)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(catalogue.ORACLE_SQL["q_coplanar_faces"]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["q_coplanar_faces"](spark, str(tmp_path)).select("a", "b").collect()]
    assert sorted(got) == sorted(want)


def test_thin_overlaps_far_from_the_origin(spark):
    flat = lambda x, z: [(x, 3e6, z), (x + 1, 3e6, z), (x, 3e6, z + 1)]
    step = 2.0**-29  # some 2e-9; doubles at 4 million are 2**-31 apart
    rows = [(k, k, flat(4e6 + x, 4e6)) for k, x in enumerate((0.0, 1 - step, 1.0, 1 + step))]
    assert pairs(faces.coplanar_overlaps(triangles(spark, rows), depth=0.0)) == {(0, 1), (1, 2), (1, 3), (2, 3)}
