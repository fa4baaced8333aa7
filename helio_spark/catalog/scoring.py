"""Forecast and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helio_spark.catalog.features import solar_sql
from helio_spark.catalog.frames import FOLDS_SQL
from helio_spark.catalog.inputs import (
    HORIZON,
    HOURLY_SQL,
    METHODS,
    SITES_SQL,
    forecasts,
    forecasts_sql,
    hourly_plain,
    raw,
    rounded,
    tidy,
    with_site,
)
from helio_spark.catalog.registry import query
from helio_spark.functions.solar import add_solar_position
from helio_spark.operators.clean import keep_daylight
from helio_spark.operators.forecasts import (
    alignment_check,
    error_by_hour,
    extended_metrics,
    fold_scales,
    horizon_metrics,
    long_forecasts,
    macro_metrics,
    micro_and_horizon_metrics,
    naive_scale,
    weak_horizons,
    with_zenith,
)
from helio_spark.session import materialize
from helio_spark.operators.splits import TEST, TRAIN, VAL, fold_segments, split_rows

_RMSE = "sqrt(avg((y_true - {p}) ** 2))"
_MAE = "avg(abs(y_true - {p}))"

_SCALE_SQL = """
    lg AS (SELECT series_id, pv, lag(pv, 24) OVER (PARTITION BY series_id ORDER BY time_idx) AS l
           FROM sp WHERE split = 'train'),
    sc AS (SELECT series_id, avg(abs(pv - l)) AS scale FROM lg GROUP BY 1)"""

_METRICS_SQL = f"""{forecasts_sql()}, {_SCALE_SQL},
    me AS (SELECT series_id, horizon_h, count(*) AS n, {_RMSE.format(p='mean')} AS rmse_model,
                  {_RMSE.format(p='day')} AS rmse_naive, {_MAE.format(p='mean')} AS am,
                  {_MAE.format(p='day')} AS an
           FROM fc WHERE split = 'test' AND day IS NOT NULL GROUP BY 1, 2),
    mh AS (SELECT me.*, am / scale AS mase_model, an / scale AS mase_naive
           FROM me JOIN sc USING (series_id))"""
_SCORES = ("rmse_model", "rmse_naive", "mase_model", "mase_naive")


def per_horizon(spark, sf_dir):
    """Test scores of the recent mean against persistence, scaled on the train rows."""
    rows = split_rows(raw(spark, sf_dir).select("series_id", "time_idx", "pv"))
    scale = naive_scale(rows.where(F.col("split") == TRAIN))
    test = forecasts(spark, sf_dir, splits=True).where(F.col("split") == TEST)
    return horizon_metrics(test, scale, pred="mean", naive="day")


@query(
    "persistence_forecasts",
    f"""
    WITH {forecasts_sql()}
    SELECT series_id, time_idx, origin_ts, forecast_ts, horizon_h,
           {rounded('y_true', 'day', 'week', 'mean')}
    FROM fc""",
)
def persistence_forecasts(spark, sf_dir):
    return tidy(forecasts(spark, sf_dir))


@query(
    "metrics_by_horizon",
    f"WITH {_METRICS_SQL} SELECT series_id, horizon_h, n, {rounded(*_SCORES)} FROM mh",
)
def metrics_by_horizon(spark, sf_dir):
    return tidy(per_horizon(spark, sf_dir))


@query(
    "metrics_macro",
    f"""
    WITH {_METRICS_SQL},
    ma AS (SELECT series_id, {', '.join(f'avg({c}) AS {c}' for c in _SCORES)} FROM mh GROUP BY 1)
    SELECT series_id, {rounded(*_SCORES, '(1 - rmse_model / rmse_naive) * 100 AS skill_pct')} FROM ma""",
)
def metrics_macro(spark, sf_dir):
    return tidy(macro_metrics(per_horizon(spark, sf_dir)))


@query(
    "weak_horizons",
    f"""
    WITH {_METRICS_SQL}
    SELECT series_id, horizon_h, n, {rounded(*_SCORES)} FROM mh WHERE mase_model >= 0.8""",
)
def weak(spark, sf_dir):
    return tidy(weak_horizons(per_horizon(spark, sf_dir), limit=0.8))


@query(
    "metrics_micro",
    f"""
    WITH {forecasts_sql()}
    SELECT series_id, horizon_h, count(*) AS n,
           {rounded(_RMSE.format(p='mean') + ' AS rmse', _MAE.format(p='mean') + ' AS mae')}
    FROM fc GROUP BY GROUPING SETS ((series_id, horizon_h), (series_id))""",
)
def metrics_micro(spark, sf_dir):
    return tidy(micro_and_horizon_metrics(forecasts(spark, sf_dir), "mean"))


_EXTENDED = (
    f"{_RMSE.format(p='mean')} AS rmse",
    f"{_MAE.format(p='mean')} AS mae",
    f"{_RMSE.format(p='mean')} / (max(y_true) - min(y_true)) AS nrmse_range",
    f"{_RMSE.format(p='mean')} / avg(y_true) AS nrmse_mean",
    "1 - sum((y_true - mean) ** 2) / (count(*) * var_pop(y_true)) AS r2",
    "avg(mean - y_true) AS bias",
)


@query(
    "metrics_extended",
    f"""
    WITH {forecasts_sql()}
    SELECT series_id, horizon_h, count(*) AS n, {rounded(*_EXTENDED)} FROM fc GROUP BY 1, 2""",
)
def metrics_extended(spark, sf_dir):
    return tidy(extended_metrics(forecasts(spark, sf_dir), "mean", ("series_id", "horizon_h")))


@query(
    "error_by_hour",
    f"""
    WITH {forecasts_sql()}
    SELECT hour(forecast_ts) AS hour_of_day, count(*) AS n, {rounded(*_EXTENDED[:2])}
    FROM fc GROUP BY 1""",
)
def by_hour(spark, sf_dir):
    return tidy(error_by_hour(forecasts(spark, sf_dir), "mean"))


_ZENITH_SQL = f"""{forecasts_sql()}, {SITES_SQL},
    rs AS (SELECT * FROM r JOIN sites USING (series_id)), {solar_sql('rs')}"""


def _placed(spark, sf_dir):
    rows = with_site(raw(spark, sf_dir).select("series_id", "time_idx", "ts", "pv")).drop("tz")
    return add_solar_position(rows)


_AT_FORECAST = "s.series_id = fc.series_id AND s.time_idx = fc.time_idx + fc.horizon_h"


@query(
    "metrics_daylight",
    f"""
    WITH {_ZENITH_SQL}
    SELECT fc.horizon_h, count(*) AS n, {rounded(*_EXTENDED)}
    FROM fc LEFT JOIN sun s ON {_AT_FORECAST}
    WHERE sp_zenith IS NULL OR sp_zenith <= 90 GROUP BY 1""",
)
def metrics_daylight(spark, sf_dir):
    """The zenith of the forecast row travels with the truth, without a join."""
    seen = long_forecasts(_placed(spark, sf_dir), HORIZON, METHODS, ahead=["sp_zenith"])
    return tidy(extended_metrics(keep_daylight(seen), "mean"))


@query(
    "forecast_zenith",
    f"""
    WITH {_ZENITH_SQL}
    SELECT fc.series_id, fc.time_idx, fc.horizon_h, {rounded('sp_zenith')}
    FROM fc LEFT JOIN sun s ON {_AT_FORECAST}""",
)
def forecast_zenith(spark, sf_dir):
    """The zenith of the forecast row comes with its truth, without a join."""
    seen = long_forecasts(_placed(spark, sf_dir), HORIZON, METHODS, ahead=["sp_zenith"])
    return tidy(seen.select("series_id", "time_idx", "horizon_h", "sp_zenith"))


@query(
    "origin_zenith",
    f"""
    WITH {_ZENITH_SQL}
    SELECT fc.series_id, fc.time_idx, fc.horizon_h, {rounded('sp_zenith')}
    FROM fc LEFT JOIN sun s ON s.series_id = fc.series_id AND s.time_idx = fc.time_idx""",
)
def origin_zenith(spark, sf_dir):
    seen = long_forecasts(_placed(spark, sf_dir), HORIZON, METHODS, keep=["sp_zenith"])
    return tidy(seen.select("series_id", "time_idx", "horizon_h", "sp_zenith"))


@query(
    "stored_zenith",
    f"""
    WITH {_ZENITH_SQL}
    SELECT fc.series_id, fc.time_idx, fc.horizon_h, {rounded('sp_zenith')}
    FROM fc LEFT JOIN sun s ON {_AT_FORECAST}""",
)
def stored_zenith(spark, sf_dir):
    """For forecasts that were stored without it: the zenith of the forecast row by its index."""
    placed = materialize(_placed(spark, sf_dir), "placed")
    stored = long_forecasts(placed.drop("sp_zenith", "sp_azimuth"), HORIZON, METHODS)
    return tidy(with_zenith(stored, placed).select("series_id", "time_idx", "horizon_h", "sp_zenith"))


@query(
    "fold_metrics",
    f"""
    WITH {forecasts_sql()}, {FOLDS_SQL.format(t='r')},
    lg AS (SELECT fo.series_id, fold, pv,
                  lag(pv, 24) OVER (PARTITION BY fo.series_id, fold ORDER BY time_idx) AS l
           FROM r JOIN fo ON fo.series_id = r.series_id AND r.time_idx < fo.train_end),
    sc AS (SELECT series_id, fold, avg(abs(pv - l)) AS scale FROM lg GROUP BY 1, 2),
    me AS (SELECT fc.series_id, fold, horizon_h, count(*) AS n, {_RMSE.format(p='mean')} AS rmse_model,
                  {_RMSE.format(p='day')} AS rmse_naive, {_MAE.format(p='mean')} AS am,
                  {_MAE.format(p='day')} AS an
           FROM fc JOIN fo ON fo.series_id = fc.series_id AND fc.time_idx >= train_end
                          AND fc.time_idx < val_end
           WHERE day IS NOT NULL GROUP BY 1, 2, 3)
    SELECT series_id, fold, horizon_h, n,
           {rounded('rmse_model', 'rmse_naive', 'am / scale AS mase_model', 'an / scale AS mase_naive')}
    FROM me JOIN sc USING (series_id, fold)""",
)
def fold_metrics(spark, sf_dir):
    """Scores of each walk-forward block, scaled on that fold's train rows."""
    rows = raw(spark, sf_dir).select("series_id", "time_idx", "ts", "pv")
    placed = fold_segments(rows, 5)
    blocks = long_forecasts(placed, HORIZON, METHODS, keep=["segment"]).where(F.col("segment") > 0)
    by = ("series_id", "fold", "horizon_h")
    scored = blocks.withColumnRenamed("segment", "fold")
    return tidy(horizon_metrics(scored, fold_scales(placed, 5), pred="mean", naive="day", by=by).withColumn("fold", F.col("fold").cast("long")))


@query(
    "alignment_check",
    f"WITH {HOURLY_SQL} SELECT series_id, {rounded('corr(pv, ghi) AS correlation')} FROM hp GROUP BY 1",
)
def alignment(spark, sf_dir):
    return tidy(alignment_check(hourly_plain(spark, sf_dir)))
