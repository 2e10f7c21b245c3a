"""The driver's entry points."""

import os

import pytest

import __spark_entry__ as E

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    assert E.entry(spark).columns == ["check", "severity", "id", "score", "rank"]
