from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helio_spark.functions.solar import (
    CLEARSKY_MODELS,
    add_clearness,
    add_clearsky,
    add_solar_position,
    add_solar_weights,
    clearness,
)
from helio_spark.functions.weather import coerce_numbers, sky_code, standardize_names


def _year(spark):
    return spark.range(8784).select(
        F.lit("a").alias("series_id"),
        (F.lit("2012-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("ts"),
    )


def test_position_bounds_and_known_noon(spark):
    out = add_solar_position(_year(spark), -33.86, 151.21).persist()
    low, high, west, east = out.select(
        F.min("sp_zenith"), F.max("sp_zenith"), F.min("sp_azimuth"), F.max("sp_azimuth")
    ).first()
    assert 0 <= low and high <= 180 and 0 <= west and east < 360
    noon = out.where("ts = '2012-12-21 02:00:00'").first()
    assert noon.sp_zenith == pytest.approx(10.5, abs=0.3)  # latitude minus declination, near noon
    # equinox sunrise stands in the east, sunset in the west
    day = out.where("to_date(ts) = '2012-03-20'").collect()
    for r in day:
        if abs(r.sp_zenith - 90) < 8:
            assert abs(r.sp_azimuth - 90) < 8 or abs(r.sp_azimuth - 270) < 8


@pytest.mark.parametrize("model", CLEARSKY_MODELS)
def test_clearsky_bounds(spark, model):
    placed = add_solar_position(_year(spark), -33.86, 151.21)
    out = add_clearsky(placed, -33.86, 151.21, model=model)
    cols = [c for c in out.columns if c.startswith("cs_")]
    assert cols == (["cs_ghi"] if model == "haurwitz" else ["cs_ghi", "cs_dni", "cs_dhi"])
    for c in cols:
        low, high, night = out.select(
            F.min(c), F.max(c), F.max(F.when(F.col("sp_zenith") >= 90, F.col(c)))
        ).first()
        assert low >= 0 and night == 0 and high < 1400
    assert 950 < out.select(F.max("cs_ghi")).first()[0] < 1150
    if model == "ineichen":
        parts = out.where("sp_zenith < 85").select(
            F.max(F.abs(F.col("cs_ghi") - F.col("cs_dhi") - F.col("cs_dni") * F.cos(F.radians("sp_zenith"))))
        )
        assert parts.first()[0] < 1e-9


def test_unknown_model(spark):
    with pytest.raises(ValueError, match="unknown clear-sky model"):
        add_clearsky(_year(spark), 0.0, 0.0, model="x")


def test_coordinates_from_columns_or_an_error(spark):
    year = _year(spark)
    with pytest.raises(ValueError, match="no coordinates"):
        add_solar_position(year)
    text = year.withColumn("lat", F.when(F.hour("ts") > 5, "-33.86").otherwise("?")).withColumn("lon", F.lit(151.21))
    same = add_solar_position(text).drop("lat", "lon").exceptAll(add_solar_position(year, -33.86, 151.21))
    assert same.count() == 0


def test_clearness(spark):
    cases = [(100.0, 0.0, None), (None, 500.0, None), (100.0, 200.0, 0.5), (900.0, 100.0, 2.0), (-5.0, 10.0, 0.0)]
    df = spark.createDataFrame(cases, "ghi double, cs_ghi double, want double")
    for r in df.withColumn("kc", clearness(F.col("ghi"), F.col("cs_ghi"))).collect():
        assert r.kc == r.want
    assert add_clearness(df, fill=0.0).where("kc is null").count() == 0


def test_weights_have_mean_one(spark):
    placed = add_solar_position(_year(spark), 45.0, 9.0)
    train = F.col("ts") < "2012-07-01"
    out = add_solar_weights(placed, where=train, gamma=1.5)
    assert out.where(train).agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
    assert out.agg(F.min("weight")).first()[0] > 0


@pytest.mark.parametrize(
    "text,code",
    [
        (None, 5), ("Sky is Clear", 10), ("few clouds", 8), ("scattered clouds", 6), ("broken clouds", 4),
        ("light rain", 2), ("heavy rain", 1), ("fog and rain", 0), ("clear, light rain", 2), ("sand", 5),
        ("Thunderstorm with mist", 0), ("mostly cloudy, partly sunny", 6),
    ],
)
def test_sky_codes(spark, text, code):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sky_code(F.col("t"))).first()[0] == code


def test_names_and_numbers(spark):
    df = spark.createDataFrame(
        [("1", None, "3", "4", "x", "rain")],
        "GHI string, Temperature string, cloud_cover string, clouds_all string, custom_feature string, weather_description string",
    )
    out = coerce_numbers(standardize_names(df), keep=())
    assert out.columns == ["ghi", "temp", "clouds", "custom_feature", "weather_description"]
    assert tuple(out.first()) == (1.0, None, 3.0, None, "rain")
