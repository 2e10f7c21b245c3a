"""Tables in the shared folder, and when they go."""

import os

import pytest

from terrane.llm import store


def folder(frame):
    return frame.inputFiles()[0].removeprefix("file://").rpartition("/")[0]


def test_scratch_drops_what_was_written_inside_unless_kept(spark):
    with store.scratch(spark):
        with store.scratch(spark):
            inner, kept = store.materialise(spark.range(3), "inner"), store.materialise(spark.range(4), "kept", keep=True)
            places = folder(inner), folder(kept)
            assert all(map(os.path.isdir, places))
        assert not os.path.isdir(places[0]) and kept.count() == 4
    assert not os.path.isdir(places[1])
    stays = store.materialise(spark.range(5), "stays")
    with pytest.raises(ZeroDivisionError), store.scratch(spark):
        gone = folder(store.materialise(spark.range(5), "gone"))
        1 / 0
    assert stays.count() == 5 and not os.path.isdir(gone)
