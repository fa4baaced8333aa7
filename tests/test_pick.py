"""First and newest rows without a sort before the partial aggregate."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helio_spark.operators.clean import dedupe_first
from helio_spark.operators.framing import latest_origin


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def copies(spark):
    rows = [("a", t, part, row, None if row % 4 == 0 else part + row / 10) for t in range(5) for part in (2, 0, 1) for row in range(part, 9, 3)]
    return spark.createDataFrame(rows, "series_id string, s long, part_no int, row_no long, pv double").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_first_row_is_one_whole_row(copies):
    got = {r.ts.timestamp(): (r.part_no, r.row_no, r.pv) for r in dedupe_first(copies.repartition(4)).collect()}
    assert len(got) == 5 and set(got.values()) == {(0, 0, None)}
    text = copies.withColumn("text", F.concat(F.lit("t"), "row_no"))
    assert {(r.part_no, r.row_no, r.text) for r in dedupe_first(text).collect()} == {(0, 0, "t0")}
    assert "SortAggregate" not in plan(dedupe_first(copies)) and "Sort " not in plan(dedupe_first(copies))
    assert dedupe_first(copies).columns == copies.columns


def test_order_that_does_not_fit_fails(copies):
    with pytest.raises(Exception, match="do not fit"):
        dedupe_first(copies.withColumn("row_no", F.lit(-1).cast("long"))).collect()
    by_value = dedupe_first(copies.na.fill(9.0), order=["pv", "row_no"])
    assert {r.pv for r in by_value.collect()} == {0.3}


def test_newest_measured_row(spark):
    rows = [("a", 10, 0, 1.0), ("a", 20, 1, 2.0), ("a", 20, 2, 3.0), ("a", 30, 3, None), ("b", 5, 0, 7.0), ("c", 5, 0, None)]
    df = spark.createDataFrame(rows, "series_id string, s long, time_idx long, pv double").withColumn("ts", F.timestamp_seconds("s"))
    want = {("a", 2, 3.0), ("b", 0, 7.0)}
    assert {(r.series_id, r.time_idx, r.pv) for r in latest_origin(df).collect()} == want
    assert "Sort" not in plan(latest_origin(df))
    text = latest_origin(df.withColumn("text", F.lit("x")))
    assert {(r.series_id, r.time_idx, r.pv) for r in text.collect()} == want
    assert {(r.series_id, r.pv) for r in latest_origin(df.drop("time_idx").where("s <> 20")).collect()} == {("a", 1.0), ("b", 7.0)}
