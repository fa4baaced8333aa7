"""Readers of measured series, weather, forecasts and weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helio_spark.functions.time import local_to_utc, parse_utc, parse_utc_strict, require_parsable
from helio_spark.functions.weather import coerce_numbers, standardize_names, to_number
from helio_spark.operators.clean import dedupe_first
from helio_spark.operators.ordering import SERIES, TS
from helio_spark.session import require_utc

FORECAST_SCHEMA = (
    "series_id string, time_idx long, origin_ts timestamp, forecast_ts timestamp, "
    "horizon_h int, y_true double, y_pred double, y_naive double"
)
FORECAST_REQUIRED = ("series_id", "origin_ts", "forecast_ts", "horizon_h", "y_true", "y_pred")


def format_of(path: str) -> str:
    """Spark format by file suffix; anything unknown is read as CSV."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return suffix if suffix in ("parquet", "orc", "json") else "csv"


def _load(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    fmt = format_of(path)
    reader = spark.read.format(fmt)
    return (reader.option("header", header) if fmt == "csv" else reader).load(path)


def _numbered(df: DataFrame, part_no: int) -> DataFrame:
    """Where a row stands: file, block, then the row within the block's task."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return df.withColumns({"part_no": F.lit(part_no), "row_no": place})


def _series(df: DataFrame, series_id: str | Column) -> Column:
    if SERIES in df.columns:
        return F.col(SERIES)
    return series_id if isinstance(series_id, Column) else F.lit(series_id)


def read_measured(
    spark: SparkSession, paths: Sequence[str], tz: str, series_id: str = "site_1", strict: bool = True
) -> DataFrame:
    """``series_id, ts, pv`` from parts with (local time, value) as first columns.

    Of copies of a time, the first stays: by part, then file name, then row.

    CSV parts start with one line of metadata, which is skipped. ``strict`` fails
    on an unparsable time; otherwise such rows are dropped (see
    ``split_unparsable`` to keep them aside).
    """
    require_utc(spark)
    parts = []
    for part_no, path in enumerate(paths):
        if format_of(path) == "csv":
            raw = spark.read.schema("local string, value string").csv(path, header=True)
        else:
            raw = _load(spark, path)
            raw = raw.withColumnsRenamed(dict(zip(raw.columns[:2], ["local", "value"])))
        if strict:
            require_parsable(raw, "local")
        numbered = _numbered(raw, part_no)
        parts.append(
            numbered.select(
                _series(numbered, series_id).alias(SERIES),
                local_to_utc(parse_utc(F.col("local").cast("string")), tz).alias(TS),
                to_number(F.col("value")).alias("pv"),
                "part_no",
                "row_no",
            )
        )
    rows = reduce(DataFrame.unionByName, parts).where(F.col(TS).isNotNull())
    return dedupe_first(rows).drop("part_no", "row_no")


def time_column(columns: Sequence[str]) -> str:
    """``dt_iso``, else ``timestamp``, else the first column."""
    by_name = {c.lower(): c for c in columns}
    return by_name.get("dt_iso") or by_name.get("timestamp") or columns[0]


def _weather_part(
    df: DataFrame, time: str, series_id: str | Column, parse: Callable[[Column], Column] = parse_utc
) -> DataFrame:
    keep = tuple(c for c in (SERIES, "part_no", "row_no") if c in df.columns)
    parsed = df.withColumns(
        {SERIES: _series(df, series_id), TS: parse(F.col(f"`{time}`").cast("string"))}
    )
    if time != TS:
        parsed = parsed.drop(time)
    return coerce_numbers(parsed, keep=(*keep, SERIES, TS))


def read_weather(
    spark: SparkSession, paths: Sequence[str], series_id: str = "site_1", strict: bool = True
) -> DataFrame:
    """Weather parts with offset timestamps; every column but the text is numeric."""
    require_utc(spark)
    parts = []
    for part_no, path in enumerate(paths):
        raw = _load(spark, path)
        time = time_column(raw.columns)
        if strict:
            require_parsable(raw, f"`{time}`")
        parts.append(_weather_part(_numbered(raw, part_no), time, series_id))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return dedupe_first(rows.where(F.col(TS).isNotNull())).drop("part_no", "row_no")


def read_future_weather(
    spark: SparkSession, path: str | None, series_id: str = "site_1"
) -> DataFrame | None:
    """Weather forecasts; the first column is the time. None without a path."""
    if not path:
        return None
    require_utc(spark)
    raw = _load(spark, path)
    return standardize_names(_weather_part(raw, raw.columns[0], series_id, parse_utc_strict))


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds a finished Spark write: its ``_SUCCESS`` marker is there."""
    from pyspark.errors import AnalysisException

    try:  # a path is looked up when it is analysed, on any kind of session
        return bool(spark.read.text(f"{path}/_SUCCESS").columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def read_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The stored processed table, or build and store it first."""
    from helio_spark.sources.writers import write_processed

    if not table_exists(spark, path):
        write_processed(build(), path)
    return spark.read.parquet(path)


def read_forecasts(spark: SparkSession, path: str | None, model: str) -> DataFrame | None:
    """Long forecasts of one model, optional columns as NULL; None if there are none."""
    from pyspark.errors import AnalysisException

    if not path:
        return None
    try:
        found = _load(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise  # a table that is there but cannot be read is no absent one
        return None
    absent = set(FORECAST_REQUIRED) - set(found.columns)
    if absent:
        raise ValueError(f"forecasts of {model} lack the columns {sorted(absent)}")
    types = dict(part.split(" ") for part in FORECAST_SCHEMA.split(", "))
    return found.select(
        *[
            (F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c)
            for c, t in types.items()
        ]
    )


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """``model, weight`` from a stored ``{model_names: [...], weights: [...]}``."""
    stored = spark.read.schema("model_names array<string>, weights array<double>").json(
        path, multiLine=True
    )
    return stored.select(
        F.inline(F.arrays_zip(F.col("model_names").alias("model"), F.col("weights").alias("weight")))
    )
