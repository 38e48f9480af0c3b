"""Queries whose tasks stay as large as they are, however many rows there are."""

import os

import pytest

from tessera.plans import catalog
from tessera.sources import shared

catalog.load_all()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_rows_are_dealt_to_tasks(spark, monkeypatch):
    few = spark.range(1000)
    assert shared.dealt(few, "id") is few
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    assert shared.dealt(few, "id").rdd.getNumPartitions() == 10 and shared.dealt(few, "id", rows=1701).rdd.getNumPartitions() == 18


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name, shuffles", [("periods_by_table", 2), ("co_occurrence", 2), ("previous_meetings", 2)])
def test_partitions_follow_the_rows(spark, monkeypatch, name, shuffles):
    plain = sorted(map(str, catalog.QUERIES[name](spark, FOLDER).collect()))
    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)
    df = catalog.QUERIES[name](spark, FOLDER)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") >= shuffles
    assert sorted(map(str, df.collect())) == plain


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_panels_are_dealt_by_the_rows(spark, monkeypatch):
    plain = sorted(map(str, catalog.QUERIES["official_metrics"](spark, FOLDER).collect()))
    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)
    df = catalog.QUERIES["official_metrics"](spark, FOLDER)
    assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, df.collect())) == plain


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_steps_of_career_metrics_are_tables(spark):
    """Nothing is left to read of the lines and orders once the contests, their quality and the subjects' numbers are written, and the setting of the write does not stay."""
    df = catalog.QUERIES["career_metrics"](spark, FOLDER)
    files = df.inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]
    assert spark.conf.get(shared.FREED, "false") == "false"
    few = shared.written(spark.createDataFrame([(1, None), (2, "b")], "k int, v string").repartition(3, "k"))
    assert sorted(map(tuple, few.collect())) == [(1, None), (2, "b")] and few.schema.simpleString() == "struct<k:int,v:string>"
