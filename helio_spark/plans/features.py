"""Raw series to the processed feature table, for training and for scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from helio_spark.functions.solar import add_clearness, add_clearsky, add_solar_position
from helio_spark.functions.time import add_calendar_flags, add_cyclic
from helio_spark.functions.weather import encode_weather_text, standardize_names
from helio_spark.operators.align import align, join_future_weather
from helio_spark.operators.clean import drop_and_reindex, drop_incomplete
from helio_spark.operators.history import DEFAULT_LAGS, DEFAULT_ROLLS, add_history
from helio_spark.operators.ordering import index_blocks
from helio_spark.session import materialize, require_utc

LAG_COLS = ("pv", "ghi", "dni", "dhi")
ROLL_COLS = ("pv", "ghi", "dni")


def add_row_features(
    df: DataFrame,
    holidays: DataFrame | None = None,
    lat: float | None = None,
    lon: float | None = None,
    altitude: float = 0.0,
    clearsky_model: str = "ineichen",
    turbidity: DataFrame | float = 3.0,
    include_solar: bool = True,
    include_clearsky: bool = True,
) -> DataFrame:
    """Features of a single row: no shuffle beyond small broadcast tables."""
    out = encode_weather_text(standardize_names(df))
    out = add_calendar_flags(add_cyclic(out), holidays)
    if include_solar:
        out = add_solar_position(out, lat, lon)
    if include_clearsky:
        out = add_clearsky(out, lat, lon, altitude, clearsky_model, turbidity)
        out = add_clearness(out, fill=0.0)
    return out


def engineer(
    aligned: DataFrame,
    lags: Sequence[int] = DEFAULT_LAGS,
    widths: Sequence[int] = DEFAULT_ROLLS,
    dropna: bool = True,
    **row_features,
) -> DataFrame:
    """All features of an aligned table that carries ``time_idx``."""
    rows = add_row_features(aligned, **row_features)
    lag_cols = [c for c in LAG_COLS if c in rows.columns] if lags else []
    roll_cols = [c for c in ROLL_COLS if c in rows.columns] if widths else []
    if not (lag_cols or roll_cols):
        return drop_and_reindex(rows) if dropna else rows
    if not dropna:
        return add_history(rows, lag_cols, roll_cols, lags, widths)
    framed = add_history(rows, lag_cols, roll_cols, lags, widths, keep_block="_block")
    return index_blocks(drop_incomplete(framed), "_block")


def build_features(
    measured: DataFrame, weather: DataFrame, keep_future: bool = False, **options
) -> DataFrame:
    """Align two raw series and engineer all features."""
    require_utc(measured.sparkSession)
    # stored because site coordinates are read from it before the features
    aligned = materialize(align(measured, weather, keep_future=keep_future), "aligned")
    return engineer(aligned, **options)


def build_scoring_features(
    measured: DataFrame, history: DataFrame, future: DataFrame | None, **options
) -> DataFrame:
    """The same chain for scoring: weather-only future rows stay, nothing is dropped."""
    weather = standardize_names(history) if future is None else join_future_weather(history, future)
    return build_features(measured, weather, keep_future=True, **{**options, "dropna": False})
