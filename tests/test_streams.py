"""Streams over events beside the borders of windows, against the SQL."""

import datetime as dt

import pytest

from terrane.plans import catalogue


def test_sliding_windows_of_whole_seconds(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    noon = dt.datetime(2024, 1, 5, 12)
    micros = [-1_500_001, -1_500_000, -500_001, -500_000, -499_999, -1, 0, 1, 499_999, 500_000, 43_199_499_999, 43_199_500_000, 43_200_000_000]
    rows = [(i, noon + dt.timedelta(microseconds=m), i % 2, "view", 2.0**i, "") for i, m in enumerate(micros)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(catalogue.ORACLE_SQL["q_stream_sliding"]).fetchall()
    got = [(r["user_id"], r["start"], r["n"], r["total"]) for r in catalogue.QUERIES["q_stream_sliding"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
