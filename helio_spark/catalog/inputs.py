"""Sample tables as time series, in Spark and as SQL.

Series: one per event type. ``raw`` is every event (irregular times), ``hourly``
the hourly aggregate, ``daily`` the order totals per priority and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helio_spark.functions.solar import RATED_KW
from helio_spark.operators.forecasts import PART, Persistence, RecentMean, long_forecasts
from helio_spark.operators.ordering import index_hourly, index_rows
from helio_spark.operators.splits import split_rows
from helio_spark.session import use_utc

HORIZON = 24
BLEND_HORIZON = 24
MODELS = ("day", "week", "mean")

# fixed values: one site per series
SITES = (
    ("click", -33.86, 151.21, "Australia/Sydney"),
    ("error", 45.46, 9.19, "Europe/Rome"),
    ("purchase", 40.71, -74.01, "America/New_York"),
    ("signup", -1.29, 36.82, "Africa/Nairobi"),
    ("view", 64.15, -21.94, "Atlantic/Reykjavik"),
)
# fixed values: the series whose hourly values serve as another series' weather
WEATHER_OF = {
    "error": "click",
    "purchase": "error",
    "signup": "purchase",
    "view": "signup",
    "click": "view",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table; zone-less timestamps are UTC."""
    df = use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"),
        "ts",
        "event_id",
        "user_id",
        "value",
        (F.col("value") / RATED_KW).alias("pv"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_rows(events(spark, sf_dir), ties=("event_id",))


def hourly_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(
            (F.avg("value") / RATED_KW).alias("pv"),
            (F.max("value") * 2).alias("ghi"),
            F.min("value").alias("temp"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_hourly(hourly_plain(spark, sf_dir))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather for each series; ``temp`` is missing in single-event hours."""
    source = F.create_map(*[F.lit(x) for pair in WEATHER_OF.items() for x in pair])
    return hourly_plain(spark, sf_dir).select(
        source[F.col("series_id")].alias("series_id"),
        "ts",
        "ghi",
        F.when(F.col("n") > 1, F.col("temp")).alias("temp"),
    )


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITES, "series_id string, lat double, lon double, tz string")


def with_site(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(sites(df.sparkSession)), "series_id")


METHODS = {"day": Persistence(24), "week": Persistence(168), "mean": RecentMean(24)}


def forecasts(
    spark: SparkSession, sf_dir: str, horizon: int = HORIZON, splits: bool = False, part: bool = False
) -> DataFrame:
    """Three forecasts of every event: one season back, seven seasons back, recent mean."""
    rows = raw(spark, sf_dir)
    if splits:
        return long_forecasts(split_rows(rows), horizon, METHODS, keep=["split"], part=part)
    return long_forecasts(rows, horizon, METHODS, part=part)


def model_tables(
    spark: SparkSession, sf_dir: str, split: str | None = None
) -> dict[str, DataFrame]:
    """The three as separate forecast tables; ``week`` starts later than ``day``.

    Unrolled from the events by each, by parts: stored forecasts are many times the events, and
    as their aggregate on the forecast key would be shuffled, so were the three again.
    """
    wide = forecasts(spark, sf_dir, BLEND_HORIZON, splits=split is not None, part=True)
    if split is not None:
        wide = wide.where(F.col("split") == split)
    keys = ["series_id", "time_idx", "origin_ts", "forecast_ts", "horizon_h", PART, "y_true"]
    return {
        m: wide.where(F.col(m).isNotNull()).select(*keys, F.col(m).alias("y_pred")) for m in MODELS
    }


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: rounded doubles, 64-bit integers, zone-less timestamps."""

    def plain(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # half up on a scaled value: the built-in round goes through decimals
            c = F.floor(c.cast("double") * 10.0**digits + 0.5) / 10.0**digits
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


# --- the same tables as SQL -------------------------------------------------

EVENTS_SQL = f"""
ev AS (
  SELECT event_type AS series_id, ts, event_id, user_id, value,
         value / CAST({RATED_KW} AS DOUBLE) AS pv
  FROM events)"""

RAW_SQL = f"""{EVENTS_SQL},
r AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) - 1 AS time_idx
  FROM ev)"""

HOURLY_SQL = f"""
hp AS (
  SELECT event_type AS series_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
         avg(value) / CAST({RATED_KW} AS DOUBLE) AS pv, max(value) * 2 AS ghi,
         min(value) AS temp, count(*) AS n
  FROM events GROUP BY 1, 2),
h AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS time_idx FROM hp)"""

WEATHER_SQL = f"""{HOURLY_SQL},
wx AS (
  SELECT CASE series_id {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in WEATHER_OF.items())} END
           AS series_id,
         ts, ghi, CASE WHEN n > 1 THEN temp END AS temp
  FROM hp)"""

SITES_SQL = f"""
sites(series_id, lat, lon, tz) AS (
  VALUES {', '.join(f"('{s}', CAST({a} AS DOUBLE), CAST({o} AS DOUBLE), '{z}')" for s, a, o, z in SITES)})"""

SPLIT_SQL = """
m AS (SELECT series_id, max(time_idx) AS top FROM {t} GROUP BY 1),
sp AS (
  SELECT {t}.*, top,
         CASE WHEN time_idx <= CAST(floor(top * CAST(0.6 AS DOUBLE)) AS BIGINT) THEN 'train'
              WHEN time_idx <= CAST(floor(top * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'val'
              ELSE 'test' END AS split
  FROM {t} JOIN m USING (series_id))"""


def forecasts_sql(horizon: int = HORIZON) -> str:
    return f"""{RAW_SQL}, {SPLIT_SQL.format(t='r')},
rm AS (
  SELECT *, avg(pv) OVER (PARTITION BY series_id ORDER BY time_idx
                          ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS mean24
  FROM sp),
oh AS (
  SELECT *, time_idx + horizon_h AS at_t, time_idx + horizon_h - 24 AS at_d,
         time_idx + horizon_h - 168 AS at_w
  FROM (SELECT *, unnest(generate_series(1, {horizon})) AS horizon_h FROM rm)),
fc AS (
  SELECT o.series_id, o.time_idx, o.ts AS origin_ts, o.split,
         o.ts + to_hours(CAST(o.horizon_h AS INTEGER)) AS forecast_ts, o.horizon_h,
         t.pv AS y_true, d.pv AS day, w.pv AS week, o.mean24 AS mean
  FROM oh o
  JOIN r t ON t.series_id = o.series_id AND t.time_idx = o.at_t
  LEFT JOIN r d ON d.series_id = o.series_id AND d.time_idx = o.at_d
  LEFT JOIN r w ON w.series_id = o.series_id AND w.time_idx = o.at_w)"""


def rounded(*cols: str, digits: int = 6) -> str:
    """SQL list; ``"expr AS name"`` or a column name."""
    out = []
    for c in cols:
        expr, _, name = c.rpartition(" AS ")
        out.append(f"round({expr or name}, {digits}) + 0.0 AS {name}")
    return ", ".join(out)
