"""Joins with lookup tables by every way that their size may call for, and the removal of staged tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from palisand import storage


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("way", ["sent", "plain", "salted"])
def test_lookups_are_joins(spark, monkeypatch, how, way):
    monkeypatch.setattr(storage, "LOOKUP", 100 if way == "sent" else 0)
    rows = spark.createDataFrame([(None if i % 17 == 0 else i % 5 * (i % 3), i) for i in range(300)] + [(1, 1000)] * 50, "k int, v int")
    table = storage.staged(spark.createDataFrame([(0, "a"), (1, "b"), (4, None), (99, "z")], "k int, name string"), "table")
    got = storage.looked_up(rows, table, "k", how, F.col("v") if way == "salted" else None)
    want = rows.join(table, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) == (way == "salted")


def test_lookups_by_several_columns(spark):
    rows = spark.createDataFrame([(i % 3, str(i % 2), i) for i in range(40)], "a int, b string, v int")
    table = storage.staged(spark.createDataFrame([(0, "0", 1.5), (2, "1", 2.5)], "a int, b string, x double"), "table")
    for most in (0, 10):
        got = storage.looked_up(rows, table, ["a", "b"], "left", F.col("v"), most)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, ["a", "b"], "left").collect()))


def test_what_was_staged_on_the_way_goes(spark):
    made = []

    def make():
        part = storage.staged(spark.range(5).toDF("k"), "part")
        made.extend(part.inputFiles())
        return part.filter("k > 2")

    out = storage.finished("whole", make)
    assert out.count() == 2 and made and not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in made)
    storage.released(out)
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in out.inputFiles())
