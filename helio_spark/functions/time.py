"""Time zones, calendar features and horizons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio_spark.operators.joins import attach
from helio_spark.operators.ordering import SERIES, TS

TWO_PI = 6.283185307179586


def local_to_utc(local: Column, tz: Column | str, shift_minutes: int = 60) -> Column:
    """Naive wall clock to UTC.

    An ambiguous time (clocks go back) is standard time; a nonexistent one
    (clocks go forward) moves to the first valid instant. ``shift_minutes`` is
    the size of the zone's clock change.
    """
    zone = tz if isinstance(tz, Column) else F.lit(tz)
    wall = local.cast("timestamp")
    guess = F.to_utc_timestamp(wall, zone)
    later = guess + F.make_interval(mins=F.lit(shift_minutes))
    # A gap opens on a wall-clock multiple of its size; its opening, taken as
    # UTC, is the instant of the change.
    step = shift_minutes * 60
    opening = F.timestamp_seconds(F.floor(F.unix_seconds(wall) / step) * step)
    first_valid = F.to_utc_timestamp(opening, zone)
    return (
        F.when(F.from_utc_timestamp(guess, zone) != wall, first_valid)
        .when(F.from_utc_timestamp(later, zone) == wall, later)
        .otherwise(guess)
    )


def parse_utc(text: Column) -> Column:
    """ISO text with an offset to UTC; unparsable becomes NULL (session zone UTC)."""
    return F.try_to_timestamp(text)


def zoned_to_utc(local: Column, tz: Column | str) -> Column:
    """Wall clock of a fixed-offset zone to UTC (no clock changes to repair)."""
    zone = tz if isinstance(tz, Column) else F.lit(tz)
    return F.to_utc_timestamp(local.cast("timestamp"), zone)


def split_unparsable(df: DataFrame, text: str, parsed: str = TS) -> tuple[DataFrame, DataFrame]:
    """(rows with a valid time, rows to quarantine). Both stay lazy."""
    with_ts = df.withColumn(parsed, parse_utc(F.col(text)))
    return with_ts.where(F.col(parsed).isNotNull()), with_ts.where(F.col(parsed).isNull())


def parse_utc_strict(text: Column) -> Column:
    """Like ``parse_utc`` but the job fails on the first bad value, naming it."""
    message = F.concat(F.lit("unparsable timestamp: "), F.coalesce(text, F.lit("NULL")))
    return F.coalesce(parse_utc(text), F.raise_error(message).cast("timestamp"))


def require_parsable(df: DataFrame, text: str, shown: int = 5) -> None:
    """Raise with the first ``shown`` different values of ``text`` that are no time.

    One pass over one column; the values are sorted, so the message does not depend
    on which task comes first.
    """
    bad = df.select(F.col(text).cast("string").alias("t")).where(parse_utc(F.col("t")).isNull()).distinct()
    found = [r.t for r in bad.orderBy(F.col("t").asc_nulls_last()).limit(shown + 1).collect()]
    if found:
        values = ", ".join("NULL" if t is None else t for t in found[:shown])
        raise ValueError(f"unparsable timestamps: {values}{', ...' if len(found) > shown else ''}")


def forecast_time(origin: Column, horizon_h: Column) -> Column:
    return F.timestamp_add("HOUR", horizon_h, origin)


def cyclic_columns(ts: str = TS) -> dict[str, Column]:
    """Hour of day and day of year on the circle; leap years also use 365."""
    hour = F.hour(ts) * F.lit(TWO_PI) / 24
    day = F.dayofyear(ts) * F.lit(TWO_PI) / 365
    return {
        "hour_sin": F.sin(hour),
        "hour_cos": F.cos(hour),
        "doy_sin": F.sin(day),
        "doy_cos": F.cos(day),
    }


def add_cyclic(df: DataFrame, ts: str = TS) -> DataFrame:
    return df.withColumns(cyclic_columns(ts))


def add_calendar_flags(
    df: DataFrame, holidays: DataFrame | None = None, ts: str = TS
) -> DataFrame:
    """``is_weekend`` and ``is_holiday`` as 0/1 doubles, by UTC date.

    ``holidays`` has one ``day`` column; its different days are broadcast if they are few, as
    holidays are, and joined by date otherwise.
    """
    out = df.withColumn("is_weekend", (F.weekday(ts) >= 5).cast("double"))
    if holidays is None:
        return out.withColumn("is_holiday", F.lit(0.0))
    days = holidays.where(F.col("day").isNotNull()).select(F.to_date("day").alias("_day")).distinct()
    marked = attach(out.withColumn("_day", F.to_date(ts)), days.withColumn("_off", F.lit(1.0)), ["_day"], spread=F.col(ts))
    return marked.withColumn("is_holiday", F.coalesce("_off", F.lit(0.0))).drop("_day", "_off")


def lookup_times(
    df: DataFrame, times: DataFrame, idx: str, name: str, series: str = SERIES
) -> DataFrame:
    """Timestamp of a ``time_idx`` (``times``: series, time_idx, ts).

    Keyed by series and index, so no key is hot; a left join keeps rows whose
    index lies beyond the table.
    """
    right = times.select(series, F.col("time_idx").alias(idx), F.col(TS).alias(name))
    return df.join(right, [series, idx], "left")
