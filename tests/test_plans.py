from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helio_spark.operators.forecasts import persistence_at
from helio_spark.operators.history import target_columns
from helio_spark.operators.row_frames import with_row_frames
from helio_spark.operators.splits import split_rows
from helio_spark.plans.features import build_features, build_scoring_features
from helio_spark.plans.search import (
    best_trial,
    leaderboard,
    parameter_grid,
    remaining,
    run_trials,
    walk_forward_scores,
)
from helio_spark.plans.training import feature_importance, fit_horizons, next_day, predict_long
from helio_spark.streaming.rows import stream_row_features


def _raw(spark, hours=400):
    at = (F.lit("2010-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("ts")
    day = F.greatest(F.sin((F.col("id") % 24 - 6) / 12 * 3.14159), F.lit(0.0))
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 10000
    measured = spark.range(hours).select(F.lit("a").alias("series_id"), at, (day * 0.8 + noise).alias("pv"))
    weather = spark.range(hours + 24).select(
        F.lit("a").alias("series_id"), at, (day * 900 + noise).alias("GHI"), (day * 500).alias("dni"),
        F.lit(-33.86).alias("lat"), F.lit(151.21).alias("lon"), F.lit("few clouds").alias("weather_description"),
    )
    return measured, weather


@pytest.fixture(scope="module")
def featured(spark):
    return build_features(*_raw(spark)).persist()


def test_feature_table_names_and_index(featured):
    names = set(featured.columns)
    assert {"ghi", "hour_sin", "doy_cos", "is_weekend", "is_holiday", "sp_zenith", "cs_ghi", "cs_dni", "kc"} <= names
    assert {"pv_lag168", "ghi_lag24", "dni_lag1", "pv_roll24h", "ghi_var3h", "dni_roll12h"} <= names
    assert "dhi_lag1" not in names
    n, top, distinct, kc = featured.agg(
        F.count(F.lit(1)), F.max("time_idx"), F.count_distinct("time_idx"), F.count("kc")
    ).first()
    assert n == 400 - 168 == top + 1 == distinct == kc
    assert featured.select("weather_description").distinct().first()[0] == 8.0


def test_scoring_features_keep_the_future(spark):
    measured, weather = _raw(spark)
    future = weather.where("ts >= '2010-01-17 16:00:00'").drop("GHI").withColumn("ghi", F.lit(1.0))
    past = weather.where("ts < '2010-01-17 16:00:00'")
    rows = build_scoring_features(measured, past, future, lags=(1,), widths=(3,))
    assert rows.count() == 424 and rows.where("pv is null").count() == 24
    assert rows.where("pv is null and ghi = 1.0").count() == 24
    assert len(rows.columns) == len(set(rows.columns))


def _samples(featured):
    return with_row_frames(
        featured,
        lambda w: target_columns(w, 2) | {f"y_naive_h{h}": persistence_at(w, h) for h in (1, 2)},
        back=24,
        fwd=2,
    ).na.drop(subset=["target_h2"])


FEATURES = ["pv", "ghi", "hour_sin", "hour_cos", "sp_zenith", "pv_lag24"]


def test_models_learn_and_score_the_next_day(spark, featured):
    rows = split_rows(_samples(featured)).persist()
    models = fit_horizons(rows, FEATURES, [1, 2], maxIter=10, maxDepth=4)
    scored = predict_long(rows.where("split = 'test'"), models, FEATURES)
    rmse, spread = scored.agg(F.sqrt(F.avg((F.col("y_true") - F.col("y_pred")) ** 2)), F.stddev("y_true")).first()
    assert rmse < spread / 2
    assert scored.count() == 2 * rows.where("split = 'test'").count()
    top = feature_importance(rows, models, FEATURES, top=3).collect()
    assert len(top) == 3 and top[0].importance >= top[1].importance
    ahead = next_day(featured.drop("pv_lag24"), models, FEATURES).collect()
    assert sorted(r.horizon_h for r in ahead) == [1, 2]
    assert {r.origin_ts for r in ahead} == {featured.agg(F.max("ts")).first()[0]}


def test_walk_forward_scores(featured):
    out = walk_forward_scores(_samples(featured), FEATURES, [1], folds=2, maxIter=3, maxDepth=3).collect()
    assert sorted((r.fold, r.horizon_h) for r in out) == [(1, 1), (2, 1)]
    assert all(r.rmse_model > 0 and r.mase_naive > 0 for r in out)


def test_grid_and_trials(spark):
    grid = parameter_grid(spark, {"a": [1, 2, 3], "b": [0.1, 0.2]})
    assert [tuple(r) for r in grid.orderBy("run_id").collect()] == [
        (1, 1, 0.1), (2, 1, 0.2), (3, 2, 0.1), (4, 2, 0.2), (5, 3, 0.1), (6, 3, 0.2),
    ]
    done = spark.createDataFrame([(2, 0.1)], "a int, b double")
    assert sorted(r.run_id for r in remaining(grid, done, ["a", "b"]).collect()) == [1, 2, 4, 5, 6]
    trials = spark.createDataFrame(
        [(1, 4.0, "ok"), (2, 1.0, "failed"), (3, 2.0, "ok"), (4, None, "ok")], "run_id int, rmse double, status string"
    )
    assert best_trial(trials).first().run_id == 3
    assert [(r.run_id, r.improvement_pct) for r in leaderboard(trials, baseline=4.0).collect()] == [(3, 50.0), (1, 0.0)]


def test_row_features_on_a_stream(spark, tmp_path):
    _, weather = _raw(spark, 48)
    weather.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(weather.schema).parquet(str(tmp_path / "in"))
    made = stream_row_features(stream, -33.86, 151.21)
    query = (
        made.writeStream.format("memory").queryName("rows_out")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    query.processAllAvailable()
    query.stop()
    got = spark.table("rows_out")
    assert got.count() == 72 and got.where("kc is null or sp_zenith is null").count() == 0


def test_files_to_forecasts(spark, tmp_path):
    """From CSV parts to scored forecasts, as in the README."""
    from helio_spark.operators.history import add_targets
    from helio_spark.sources.readers import read_measured, read_weather

    measured, weather = _raw(spark)
    measured.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Max kWp"), "pv").write.csv(
        str(tmp_path / "pv"), header=True
    )
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("dt_iso")
    weather.drop("series_id").select(iso, "*").drop("ts").write.csv(str(tmp_path / "wx"), header=True)

    table = build_features(
        read_measured(spark, [str(tmp_path / "pv")], "UTC"),
        read_weather(spark, [str(tmp_path / "wx")]),
        lags=(1, 24),
        widths=(3,),
    )
    assert table.count() == 400 - 24
    rows = split_rows(add_targets(table, 2).na.drop())
    features = ["pv", "ghi", "hour_sin", "hour_cos", "sp_zenith", "pv_lag24"]
    models = fit_horizons(rows, features, range(1, 3), maxIter=3, maxDepth=3)
    scored = predict_long(rows.where("split = 'test'"), models, features)
    assert scored.where("y_pred is null").count() == 0 and scored.count() > 0


def test_trials_skip_done_and_record_failures(spark, featured):
    rows = split_rows(_samples(featured)).persist()
    grid = parameter_grid(spark, {"maxDepth": [2, 3, -1]})
    done = spark.createDataFrame([(3,)], "maxDepth int")
    trials = run_trials(rows, FEATURES, [1], grid, done, maxIter=2)
    got = {r.run_id: r for r in trials.collect()}
    assert {i: r.status for i, r in got.items()} == {1: "ok", 3: "failed"}
    assert got[1].rmse > 0 and got[1].mase > 0 and got[3].rmse is None
    assert best_trial(trials).first().run_id == 1


def test_same_features_when_nothing_may_be_broadcast(spark, featured, monkeypatch):
    from helio_spark.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    again = build_features(*_raw(spark))
    tidy = lambda d: d.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in d.dtypes])
    assert tidy(again).exceptAll(tidy(featured)).count() == 0 and again.count() == featured.count()
