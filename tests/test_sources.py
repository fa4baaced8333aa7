from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helio_spark.sources.readers import (
    format_of,
    read_forecasts,
    read_future_weather,
    read_measured,
    read_or_build,
    read_weather,
    read_weights,
    time_column,
)
from helio_spark.sources.writers import write_forecasts, write_metrics, write_processed, write_weights


def _csv(path, text):
    path.write_text(text)
    return str(path)


def test_measured_parts(spark, tmp_path):
    a = _csv(tmp_path / "a.csv", "Max kWp 82.41,\n2010-07-01 17:00:00,0.5\n2010-07-01 16:59:59.985,bad\n")
    b = _csv(tmp_path / "b.csv", "Max kWp 82.41,\n2010-07-01 17:00:00,0.9\n2010-10-03 02:30:00,0.1\n")
    rows = read_measured(spark, [a, b], "Australia/Sydney").orderBy("ts")
    got = [(r.t, r.pv) for r in rows.select(F.col("ts").cast("timestamp_ntz").alias("t"), "pv").collect()]
    assert got == [
        (dt.datetime(2010, 7, 1, 6, 59, 59, 985000), None),
        (dt.datetime(2010, 7, 1, 7), 0.5),
        (dt.datetime(2010, 10, 2, 16), 0.1),
    ]


def test_measured_rejects_bad_times(spark, tmp_path):
    path = _csv(tmp_path / "a.csv", "head,\n2010-07-01 17:00:00,0.5\nnever,1\n")
    assert read_measured(spark, [path], "UTC", strict=False).count() == 1
    with pytest.raises(Exception, match="unparsable timestamps: never"):
        read_measured(spark, [path], "UTC").collect()


def test_weather_parts_and_future(spark, tmp_path):
    a = _csv(tmp_path / "a.csv", "x,dt_iso,Ghi,weather_description\n1,2020-01-01T12:00:00+10:00,5,rain\n")
    b = _csv(tmp_path / "b.csv", "dt_iso,Ghi,clouds_all\n2020-01-01T12:00:00+10:00,7,3\n2020-01-01T13:00:00+10:00,oops,4\n")
    rows = read_weather(spark, [a, b]).orderBy("ts").collect()
    assert [(r.Ghi, r.clouds_all, r.weather_description, r.x) for r in rows] == [
        (5.0, None, "rain", 1.0),
        (None, 4.0, None, None),
    ]
    future = read_future_weather(spark, b)
    assert set(future.columns) == {"series_id", "ts", "ghi", "clouds"} and future.count() == 2
    assert read_future_weather(spark, None) is None


def test_choices_by_name():
    assert time_column(["a", "DT_ISO", "timestamp"]) == "DT_ISO"
    assert time_column(["a", "Timestamp"]) == "Timestamp"
    assert time_column(["when", "x"]) == "when"
    assert [format_of(p) for p in ("x/a.parquet", "a.CSV", "a.txt", "d/e.json")] == ["parquet", "csv", "csv", "json"]


def test_processed_store_prunes_series_and_columns(spark, tmp_path):
    path = str(tmp_path / "processed")
    rows = spark.range(100).select(
        F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("series_id"),
        F.floor(F.col("id") / 4).alias("time_idx"),
        F.col("id").cast("double").alias("pv"),
    )
    built = []

    def build():
        built.append(1)
        return rows

    assert read_or_build(spark, path, build).count() == 100
    stored = read_or_build(spark, path, build)
    assert built == [1] and stored.count() == 100
    one = stored.where("series_id = 's1'").select("pv")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(series_id" in plan and "ReadSchema: struct<pv:double>" in plan
    write_processed(rows, str(tmp_path / "flat"), by=())
    assert spark.read.parquet(str(tmp_path / "flat")).count() == 100


def test_forecast_store(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    rows = [("a", 7, t, t, 1, 1.0, 2.0, None)]
    df = spark.createDataFrame(
        rows,
        "series_id string, time_idx long, origin_ts timestamp, forecast_ts timestamp, horizon_h int, y_true double, y_pred double, y_naive double",
    )
    for fmt in ("csv", "parquet", "json"):
        path = str(tmp_path / f"f.{fmt}")
        write_forecasts(df, path, fmt)
        assert read_forecasts(spark, path, "m").select(*df.columns).collect() == df.collect()
    assert read_forecasts(spark, str(tmp_path / "none"), "m") is None
    assert read_forecasts(spark, None, "m") is None
    write_forecasts(df.drop("y_true"), str(tmp_path / "g.csv"))
    with pytest.raises(ValueError, match="y_true"):
        read_forecasts(spark, str(tmp_path / "g.csv"), "m")


def test_metrics_and_weights(spark, tmp_path):
    metrics = spark.createDataFrame([(1, 0.5)], "horizon_h int, rmse double")
    write_metrics(metrics, str(tmp_path / "m"))
    assert spark.read.schema(metrics.schema).json(str(tmp_path / "m")).collect() == metrics.collect()
    write_weights(spark, {"p": 0.25, "q": 0.75}, str(tmp_path / "w"))
    assert {r.model: r.weight for r in read_weights(spark, str(tmp_path / "w")).collect()} == {"p": 0.25, "q": 0.75}


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_stored_text_of_forecasts_is_compressed(spark, tmp_path, fmt):
    path = str(tmp_path / f"f.{fmt}")
    df = spark.range(2000).selectExpr(
        "'a' series_id", "id time_idx", "timestamp_seconds(id) origin_ts", "timestamp_seconds(id + 3600) forecast_ts", "1 horizon_h", "id / 7 y_true", "id / 9 y_pred"
    )
    write_forecasts(df, path, fmt)
    parts = [p for p in (tmp_path / f"f.{fmt}").iterdir() if p.name.startswith("part-")]
    assert parts and all(p.name.endswith(f".{fmt}.gz") for p in parts)
    assert sum(p.stat().st_size for p in parts) < 2000 * 40
    read = read_forecasts(spark, path, "m").select("time_idx", "y_pred").collect()
    assert sorted((r.time_idx, r.y_pred) for r in read) == [(i, i / 9) for i in range(2000)]
