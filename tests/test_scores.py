from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helio_spark.functions import scores
from helio_spark.operators.forecasts import (
    Persistence,
    RecentMean,
    extended_metrics,
    horizon_metrics,
    long_forecasts,
    macro_metrics,
    micro_and_horizon_metrics,
    naive_scale,
)


def _pairs(spark, y, p):
    return spark.createDataFrame(list(zip(y, p)), "y_true double, y_pred double")


def test_rmse_and_mae_known_values(spark):
    df = _pairs(spark, [3.0, -0.5, 2.0, 7.0], [2.5, 0.0, 2.0, 8.0])
    row = df.agg(scores.rmse("y_true", "y_pred").alias("r"), scores.mae("y_true", "y_pred").alias("m")).first()
    assert row.r == pytest.approx(math.sqrt(0.375)) and row.m == pytest.approx(0.5)


def test_extended_scores_against_numpy(spark):
    rng = np.random.default_rng(42)
    y = rng.random(100)
    p = y + rng.normal(0, 0.1, 100)
    row = extended_metrics(_pairs(spark, y.tolist(), p.tolist()), by=()).first()
    e = y - p
    assert row.rmse >= row.mae
    assert row.rmse == pytest.approx(np.sqrt((e**2).mean()))
    assert row.r2 == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert row.nrmse_range == pytest.approx(row.rmse / (y.max() - y.min()))
    assert row.nrmse_mean == pytest.approx(row.rmse / y.mean())
    assert row.bias == pytest.approx((p - y).mean())


def test_skill(spark):
    assert spark.range(1).select(scores.skill(F.lit(3.0), F.lit(4.0))).first()[0] == pytest.approx(25.0)
    assert spark.range(1).select(scores.skill(F.lit(3.0), F.lit(0.0))).first()[0] is None


def _train(spark, values, name="a"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "series_id string, time_idx long, pv double")


def test_naive_scale(spark):
    assert naive_scale(_train(spark, [1, 2, 3, 4, 5]), season=1).first().scale == 1.0
    assert naive_scale(_train(spark, [5, 5, 5]), season=1).first().scale is None
    with pytest.raises(Exception, match="at most 24 train rows"):
        naive_scale(_train(spark, range(24)), strict=True).collect()
    assert naive_scale(_train(spark, range(24))).first().scale is None


def test_perfect_forecast_has_mase_zero(spark):
    f = spark.createDataFrame(
        [("a", 1, 6.0, 6.0, 5.0), ("a", 1, 7.0, 7.0, 6.0)], "series_id string, horizon_h int, y_true double, y_pred double, y_naive double"
    )
    row = horizon_metrics(f, naive_scale(_train(spark, [1, 2, 3, 4, 5]), season=1)).first()
    assert (row.mase_model, row.mase_naive, row.rmse_model, row.n) == (0.0, 1.0, 0.0, 2)


@pytest.mark.parametrize("n,horizon", [(200, 24), (30, 24), (400, 7)])
def test_long_forecasts_by_brute_force(spark, n, horizon):
    rng = np.random.default_rng(3)
    pv = [None if rng.random() < 0.1 else float(v) for v in rng.random(n)]
    rows = [("a", i, v) for i, v in enumerate(pv)]
    df = spark.createDataFrame(rows, "series_id string, time_idx long, pv double").withColumn(
        "ts", F.timestamp_seconds(F.col("time_idx") * 3600)
    )
    got = {
        (r.time_idx, r.horizon_h): (r.y_true, r.day, r.week, r.mean)
        for r in long_forecasts(df, horizon, {"day": Persistence(24), "week": Persistence(168), "mean": RecentMean(24)}).collect()
    }
    want = {}
    for t in range(n):
        recent = [v for v in pv[max(0, t - 23) : t + 1] if v is not None]
        for h in range(1, horizon + 1):
            if t + h < n and pv[t + h] is not None:
                at = lambda i: pv[i] if i >= 0 else None
                want[t, h] = (pv[t + h], at(t + h - 24), at(t + h - 168), sum(recent) / len(recent) if recent else None)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_persistence_needs_a_season_as_long_as_the_horizon(spark):
    df = _train(spark, [1, 2]).withColumn("ts", F.timestamp_seconds("time_idx"))
    with pytest.raises(ValueError, match="exceeds the season"):
        long_forecasts(df, 25, {"day": Persistence(24)})


def test_micro_and_macro(spark):
    f = spark.createDataFrame(
        [("a", 1, 1.0, 2.0), ("a", 1, 1.0, 1.0), ("a", 2, 1.0, 4.0)], "series_id string, horizon_h int, y_true double, y_pred double"
    )
    rows = {r.horizon_h: r for r in micro_and_horizon_metrics(f).collect()}
    assert rows[None].n == 3 and rows[None].mae == pytest.approx(4 / 3) and rows[2].rmse == 3.0
    per_h = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 2.0, 4.0)], "series_id string, horizon_h int, rmse_model double, rmse_naive double")
    macro = macro_metrics(per_h).first()
    assert (macro.rmse_model, macro.rmse_naive, macro.skill_pct) == (1.5, 3.0, 50.0)
