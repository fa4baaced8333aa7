"""Readers and writers, checked by a round trip over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helio_spark.catalog.inputs import (
    HOURLY_SQL,
    RAW_SQL,
    forecasts,
    forecasts_sql,
    hourly_plain,
    raw,
    rounded,
    table,
    tidy,
)
from helio_spark.catalog.registry import query
from helio_spark.operators.blending import blend_stacked
from helio_spark.operators.forecasts import PLACES, micro_and_horizon_metrics, unpivot_models
from helio_spark.session import shared_dir
from helio_spark.sources.readers import (
    read_forecasts,
    read_future_weather,
    read_measured,
    read_or_build,
    read_weather,
    read_weights,
)
from helio_spark.sources.writers import write_forecasts, write_metrics, write_weights


def _new_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "measured_parts",
    """
    SELECT 'site_1' AS series_id, timezone('UTC', timezone('Australia/Sydney', ts)) AS ts,
           CASE WHEN event_id % 8 = 0 THEN NULL ELSE value END AS pv
    FROM events""",
)
def measured_parts(spark, sf_dir):
    """Two CSV parts that repeat every time; the first part counts."""
    path = _new_path(spark, "measured")
    local = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("local")
    rows = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 8 == 0, "fault").otherwise(F.col("value").cast("string"))
    rows.select(local, text.alias("value")).write.csv(f"{path}/a", header=True)
    rows.select(local, (F.col("value") + 1).cast("string").alias("value")).write.csv(
        f"{path}/b", header=True
    )
    return tidy(read_measured(spark, [f"{path}/a", f"{path}/b"], "Australia/Sydney"))


@query(
    "weather_parts",
    f"""
    WITH {HOURLY_SQL}
    SELECT series_id, ts - INTERVAL 10 HOUR AS ts, ghi AS Ghi, CAST(NULL AS DOUBLE) AS clouds_all,
           'clear sky' AS weather_description FROM hp
    UNION ALL
    SELECT series_id || '_b', ts - INTERVAL 10 HOUR, CAST(NULL AS DOUBLE), temp, 'fog' FROM hp""",
)
def weather_parts(spark, sf_dir):
    """Parts in two formats with different columns."""
    path = _new_path(spark, "weather")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+10:00")).alias("dt_iso")
    rows = hourly_plain(spark, sf_dir)
    rows.select(
        "series_id", iso, F.col("ghi").alias("Ghi"), F.lit("clear sky").alias("weather_description")
    ).write.csv(f"{path}/a.csv", header=True)
    rows.select(
        F.concat("series_id", F.lit("_b")).alias("series_id"),
        iso,
        F.col("temp").alias("clouds_all"),
        F.lit("fog").alias("weather_description"),
    ).write.parquet(f"{path}/b.parquet")
    return tidy(read_weather(spark, [f"{path}/a.csv", f"{path}/b.parquet"]))


@query(
    "future_weather_file",
    f"WITH {HOURLY_SQL} SELECT series_id, ts, ghi, temp FROM hp",
)
def future_weather_file(spark, sf_dir):
    path = _new_path(spark, "future") + ".parquet"
    hourly_plain(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("when"),
        "series_id",
        F.col("ghi").cast("string").alias("GHI(W/m2)"),
        F.col("temp").alias("Temperature"),
    ).write.parquet(path)
    return tidy(read_future_weather(spark, path))


def _not_again():
    raise RuntimeError("the stored table was not found again")


@query(
    "processed_store",
    f"WITH {RAW_SQL} SELECT series_id, time_idx, ts, {rounded('pv')} FROM r WHERE series_id = 'click'",
)
def processed_store(spark, sf_dir):
    """Built and stored on the first read; then one site's folder is scanned."""
    path = _new_path(spark, "processed")
    read_or_build(spark, path, lambda: raw(spark, sf_dir).select("series_id", "time_idx", "ts", "pv"))
    stored = read_or_build(spark, path, _not_again)
    return tidy(stored.where(F.col("series_id") == "click"))


@query(
    "forecast_store",
    f"""
    WITH {forecasts_sql()}
    SELECT series_id, time_idx, origin_ts, forecast_ts, horizon_h,
           {rounded('y_true', 'mean AS y_pred', 'day AS y_naive')}
    FROM fc""",
)
def forecast_store(spark, sf_dir):
    path = _new_path(spark, "forecasts")
    made = forecasts(spark, sf_dir).withColumnsRenamed({"mean": "y_pred", "day": "y_naive"})
    write_forecasts(made.drop("week"), path)
    return tidy(read_forecasts(spark, path, "mean"))


@query(
    "metric_store",
    f"""
    WITH {forecasts_sql()}
    SELECT series_id, horizon_h, count(*) AS n, {rounded('sqrt(avg((y_true - mean) ** 2)) AS rmse',
        'avg(abs(y_true - mean)) AS mae')}
    FROM fc GROUP BY GROUPING SETS ((series_id, horizon_h), (series_id))""",
)
def metric_store(spark, sf_dir):
    path = _new_path(spark, "metrics")
    metrics = micro_and_horizon_metrics(forecasts(spark, sf_dir), "mean")
    write_metrics(metrics, path)
    return tidy(spark.read.schema(metrics.schema).json(path))


@query(
    "weight_store",
    f"""
    WITH {forecasts_sql()}
    SELECT series_id, origin_ts, horizon_h, {rounded('y_true', '0.7 * day + 0.3 * mean AS y_pred')}
    FROM fc WHERE day IS NOT NULL""",
)
def weight_store(spark, sf_dir):
    """Blend with weights read back from their file."""
    path = _new_path(spark, "weights")
    write_weights(spark, {"day": 0.7, "mean": 0.3}, path)
    rows = forecasts(spark, sf_dir).where(F.col("day").isNotNull())
    stacked = unpivot_models(rows.select(*PLACES, "y_true", "day", "mean"), ["day", "mean"])
    return tidy(blend_stacked(stacked, read_weights(spark, path), PLACES).drop("time_idx"))
