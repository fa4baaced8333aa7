"""Ingest, cleaning, time and profile queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from helio_spark.catalog.inputs import (
    EVENTS_SQL,
    HOURLY_SQL,
    RAW_SQL,
    SITES_SQL,
    WEATHER_SQL,
    events,
    hourly,
    hourly_plain,
    raw,
    rounded,
    table,
    tidy,
    weather,
    with_site,
)
from helio_spark.catalog.registry import query
from helio_spark.functions.time import (
    add_calendar_flags,
    add_cyclic,
    local_to_utc,
    lookup_times,
    split_unparsable,
    zoned_to_utc,
)
from helio_spark.functions.weather import coerce_numbers, encode_weather_text, standardize_names
from helio_spark.operators.align import align, join_future_weather
from helio_spark.operators.clean import (
    conform,
    dedupe_first,
    drop_and_reindex,
    feature_columns,
    keep_measured,
)
from helio_spark.operators.history import add_lags
from helio_spark.operators.ordering import index_hourly
from helio_spark.operators.profile import null_profile, range_statistics, value_distribution

# fixed values: sample holidays
HOLIDAYS = ("2024-01-01", "2024-01-15", "2024-01-26")

# fixed values: sample weather texts, chosen by user_id
WEATHER_TEXTS = (
    "Sky is Clear", "few clouds", "Partly sunny", "scattered clouds", "mostly cloudy",
    "broken clouds", "overcast clouds", "light rain", "heavy intensity rain", "Thunderstorm",
    "drizzle", "light snow", "mist", "Haze over clear sky", "fog and rain", "dust",
    "heavy cloud", "sunny with few clouds", "rain with broken clouds",
)
_TEXTS_SQL = "[" + ", ".join(f"'{t}'" for t in WEATHER_TEXTS) + "]"


@query(
    "hourly_series",
    f"WITH {HOURLY_SQL} SELECT series_id, ts, time_idx, {rounded('pv', 'ghi', 'temp')}, n FROM h",
)
def hourly_series(spark, sf_dir):
    return tidy(hourly(spark, sf_dir).select("series_id", "ts", "time_idx", "pv", "ghi", "temp", "n"))


@query(
    "row_index",
    f"WITH {RAW_SQL} SELECT series_id, ts, event_id, time_idx FROM r",
)
def row_index(spark, sf_dir):
    return tidy(raw(spark, sf_dir).select("series_id", "ts", "event_id", "time_idx"))


@query(
    "dedupe_first",
    """
    WITH p AS (SELECT event_type AS series_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
                      user_id % 3 AS part_no, event_id AS row_no, value FROM events),
         k AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY part_no, row_no) AS rn
               FROM p)
    SELECT series_id, ts, part_no, row_no, value FROM k WHERE rn = 1""",
)
def dedupe(spark, sf_dir):
    copies = events(spark, sf_dir).select(
        "series_id",
        F.date_trunc("hour", "ts").alias("ts"),
        (F.col("user_id") % 3).alias("part_no"),
        F.col("event_id").alias("row_no"),
        "value",
    )
    return tidy(dedupe_first(copies))


@query(
    "numeric_coercion",
    """
    SELECT event_id, event_type AS weather_description,
           CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS reading,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
    FROM events""",
)
def numeric_coercion(spark, sf_dir):
    bad = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 7 == 1, "NaN")
    texts = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("weather_description"),
        F.coalesce(bad, F.col("value").cast("string")).alias("reading"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    return tidy(coerce_numbers(texts, keep=("event_id",)))


@query(
    "canonical_names",
    """
    SELECT event_id, value AS ghi, value * 2 AS temp,
           coalesce(CASE WHEN event_id % 2 = 0 THEN value END, user_id) AS clouds,
           user_id AS wind, event_type AS custom_feature
    FROM events""",
)
def canonical_names(spark, sf_dir):
    messy = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("value").alias("GHI"),
        (F.col("value") * 2).alias("Temperature"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("clouds_all"),
        F.col("user_id").cast("double").alias("cloud_cover"),
        F.col("user_id").alias("Wind"),
        F.col("event_type").alias("custom_feature"),
    )
    return tidy(standardize_names(messy))


@query(
    "model_features",
    f"WITH {EVENTS_SQL} SELECT series_id, ts, event_id, user_id, value, {rounded('pv')},"
    " CAST(NULL AS DOUBLE) AS humidity FROM ev",
)
def model_features(spark, sf_dir):
    """All-missing columns are no features; a feature the table lacks is missing."""
    rows = events(spark, sf_dir).withColumn("dew_point", F.lit(None).cast("double"))
    return tidy(conform(rows, [*feature_columns(rows), "humidity"]))


@query(
    "drop_and_reindex",
    f"""
    WITH {RAW_SQL},
    l AS (SELECT series_id, ts, time_idx AS old, pv, lag(pv, 24) OVER (PARTITION BY series_id ORDER BY time_idx) AS pv_lag24
          FROM r)
    SELECT series_id, ts, {rounded('pv', 'pv_lag24')},
           row_number() OVER (PARTITION BY series_id ORDER BY old) - 1 AS time_idx
    FROM l WHERE pv_lag24 IS NOT NULL""",
)
def dropped(spark, sf_dir):
    lagged = add_lags(raw(spark, sf_dir).select("series_id", "ts", "time_idx", "pv"), ["pv"], [24])
    return tidy(drop_and_reindex(lagged))


_ALIGN_SQL = """
    WITH {wx},
    al AS (
      SELECT coalesce(m.series_id, w.series_id) AS series_id, coalesce(m.ts, w.ts) AS ts, m.pv,
             w.ghi, w.temp
      FROM m FULL JOIN wx w ON w.series_id = m.series_id AND w.ts = m.ts),
    ff AS (
      SELECT series_id, ts, pv,
             last_value(ghi IGNORE NULLS) OVER w AS ghi, last_value(temp IGNORE NULLS) OVER w AS temp
      FROM al
      WINDOW w AS (PARTITION BY series_id ORDER BY ts
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS time_idx,
           {cols}
    FROM ff {where}"""
_MEASURED_SQL = f"{EVENTS_SQL}, m AS (SELECT series_id, ts, pv FROM ev)"


@query(
    "asof_align",
    _ALIGN_SQL.format(
        wx=f"{WEATHER_SQL}, {_MEASURED_SQL}",
        cols=rounded("pv", "ghi", "temp"),
        where="WHERE pv IS NOT NULL",
    ),
)
def asof_align(spark, sf_dir):
    return tidy(
        align(events(spark, sf_dir), weather(spark, sf_dir)).select(
            "series_id", "ts", "time_idx", "pv", "ghi", "temp"
        )
    )


_COPIES_SQL = f"""
    WITH {WEATHER_SQL}, {EVENTS_SQL},
    mc AS (SELECT series_id, ts, CASE WHEN event_id % 8 > 0 THEN pv END AS pv, 0 AS part FROM ev
           UNION ALL SELECT series_id, ts, pv + 1, 1 FROM ev WHERE event_id % 3 = 0
           UNION ALL SELECT series_id, ts, pv + 2, 2 FROM ev WHERE event_id % 24 = 0),
    m1 AS (SELECT series_id, ts, arg_min(pv, part) FILTER (WHERE pv IS NOT NULL) AS pv FROM mc GROUP BY 1, 2),
    wc AS (SELECT series_id, ts, ghi, temp, 0 AS part FROM wx
           UNION ALL SELECT series_id, ts, ghi + 100, temp + 5, 1 FROM wx WHERE hour(ts) % 2 = 0),
    al AS (SELECT series_id, ts, CAST(NULL AS DOUBLE) AS pv, ghi, temp, part * 2 AS place, part FROM wc
           UNION ALL SELECT series_id, ts, pv, NULL, NULL, 1, 0 FROM m1),
    ff AS (SELECT series_id, ts, pv, place, last_value(ghi IGNORE NULLS) OVER w AS ghi, last_value(temp IGNORE NULLS) OVER w AS temp
           FROM al WINDOW w AS (PARTITION BY series_id ORDER BY ts, place, part
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS time_idx, {rounded("pv", "ghi", "temp")}
    FROM ff WHERE place = 1 AND pv IS NOT NULL"""


@query("asof_copies", _COPIES_SQL)
def asof_copies(spark, sf_dir):
    """Copies of measured and weather rows: the first value counts, later weather copies fill later times."""
    rows = events(spark, sf_dir)
    part = lambda df, n, pv: df.select("series_id", "ts", pv.alias("pv"), F.lit(n).alias("part_no"))
    faulty = F.when(F.col("event_id") % 8 > 0, F.col("pv"))
    measured = (
        part(rows, 0, faulty)
        .unionByName(part(rows.where("event_id % 3 = 0"), 1, F.col("pv") + 1))
        .unionByName(part(rows.where("event_id % 24 = 0"), 2, F.col("pv") + 2))
    )
    wx = weather(spark, sf_dir).withColumn("part_no", F.lit(0))
    again = wx.where(F.hour("ts") % 2 == 0).withColumns({"ghi": F.col("ghi") + 100, "temp": F.col("temp") + 5, "part_no": F.lit(1)})
    made = align(measured, wx.unionByName(again), order=["part_no"], slices=16)
    return tidy(made.select("series_id", "ts", "time_idx", "pv", "ghi", "temp"))


@query(
    "align_keep_future",
    _ALIGN_SQL.format(
        wx=f"{WEATHER_SQL}, m AS (SELECT series_id, ts, CASE WHEN n < 4 THEN pv END AS pv FROM hp)",
        cols=rounded("pv", "ghi", "temp"),
        where="",
    ),
)
def align_keep_future(spark, sf_dir):
    """Hourly measurements, missing in busy hours: weather-only rows stay."""
    measured = hourly_plain(spark, sf_dir).select(
        "series_id", "ts", F.when(F.col("n") < 4, F.col("pv")).alias("pv")
    )
    return tidy(
        align(measured, weather(spark, sf_dir), keep_future=True).select(
            "series_id", "ts", "time_idx", "pv", "ghi", "temp"
        )
    )


@query(
    "keep_measured",
    f"WITH {HOURLY_SQL} SELECT series_id, ts, {rounded('pv')} FROM hp WHERE n < 4 AND pv IS NOT NULL",
)
def measured_rows(spark, sf_dir):
    gaps = hourly_plain(spark, sf_dir).select(
        "series_id", "ts", F.when(F.col("n") < 4, F.col("pv")).alias("pv")
    )
    return tidy(keep_measured(gaps))


@query(
    "future_weather_union",
    f"""
    WITH {HOURLY_SQL}
    SELECT series_id, ts, {rounded('ghi', 'temp')}, CAST(NULL AS DOUBLE) AS humidity FROM hp
    UNION ALL
    SELECT series_id, ts + INTERVAL 30 DAY, {rounded('ghi')}, CAST(NULL AS DOUBLE), {rounded('temp')}
    FROM hp""",
)
def future_weather_union(spark, sf_dir):
    """Two weather tables with different spellings become one."""
    past = hourly_plain(spark, sf_dir).select("series_id", "ts", F.col("ghi").alias("Ghi"), "temp")
    ahead = hourly_plain(spark, sf_dir).select(
        "series_id",
        (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
        F.col("ghi").alias("GHI(W/m2)"),
        F.col("temp").alias("Humidity"),
    )
    return tidy(join_future_weather(past, ahead))


@query(
    "calendar_cyclic",
    """
    SELECT event_id, ts,
           round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin,
           round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos,
           round(sin(2 * pi() * dayofyear(ts) / 365), 6) + 0.0 AS doy_sin,
           round(cos(2 * pi() * dayofyear(ts) / 365), 6) + 0.0 AS doy_cos
    FROM events""",
)
def calendar_cyclic(spark, sf_dir):
    return tidy(add_cyclic(table(spark, sf_dir, "events").select("event_id", "ts")))


@query(
    "calendar_flags",
    f"""
    SELECT event_id, ts, CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_weekend,
           CASE WHEN strftime(ts, '%Y-%m-%d') IN {HOLIDAYS} THEN 1.0 ELSE 0.0 END::DOUBLE AS is_holiday
    FROM events""",
)
def calendar_flags(spark, sf_dir):
    days = spark.createDataFrame(
        [(datetime.date.fromisoformat(d),) for d in HOLIDAYS], "day date"
    )
    return tidy(add_calendar_flags(table(spark, sf_dir, "events").select("event_id", "ts"), days))


@query(
    "local_to_utc",
    """
    WITH l AS (SELECT o_orderkey,
                      o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))
                                  + to_minutes(CAST(o_custkey % 60 AS INTEGER)) AS local
               FROM orders),
         g AS (SELECT *, timezone('Australia/Sydney', local) AS u FROM l)
    SELECT o_orderkey, local,
           CASE WHEN timezone('Australia/Sydney', u) <> local
                THEN date_trunc('hour', timezone('UTC', u)) ELSE timezone('UTC', u) END AS ts
    FROM g""",
)
def localized(spark, sf_dir):
    """Order times over six years, which cross every clock change of the zone."""
    clock = F.make_interval(
        hours=(F.col("o_orderkey") % 24).cast("int"), mins=(F.col("o_custkey") % 60).cast("int")
    )
    local = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderdate") + clock).alias("local")
    )
    return tidy(local.withColumn("ts", local_to_utc(F.col("local"), "Australia/Sydney")))


@query(
    "zoned_to_utc",
    """
    SELECT o_orderkey, o_orderdate + INTERVAL 5 HOUR AS ts FROM orders""",
)
def zoned(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return tidy(rows.select("o_orderkey", zoned_to_utc(F.col("o_orderdate"), "-05:00").alias("ts")))


_OFFSETS = ("+10:00", "-03:30", "Z")


def _offset_texts(spark, sf_dir):
    offset = F.element_at(F.array(*map(F.lit, _OFFSETS)), (F.col("user_id") % 3 + 1).cast("int"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), offset)
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 9 == 0, "not a time").otherwise(text).alias("dt_iso")
    )


@query(
    "parse_offsets",
    """
    SELECT event_id, ts - CASE user_id % 3 WHEN 0 THEN INTERVAL 600 MINUTE
                                           WHEN 1 THEN INTERVAL (-210) MINUTE
                                           ELSE INTERVAL 0 MINUTE END AS ts
    FROM events WHERE event_id % 9 <> 0""",
)
def parse_offsets(spark, sf_dir):
    good, _ = split_unparsable(_offset_texts(spark, sf_dir), "dt_iso")
    return tidy(good.select("event_id", "ts"))


@query(
    "quarantine",
    "SELECT event_id, 'not a time' AS dt_iso FROM events WHERE event_id % 9 = 0",
)
def quarantine(spark, sf_dir):
    _, bad = split_unparsable(_offset_texts(spark, sf_dir), "dt_iso")
    return tidy(bad.select("event_id", "dt_iso"))


@query(
    "index_to_time",
    f"""
    WITH {RAW_SQL}
    SELECT a.series_id, a.time_idx AS origin_idx, a.time_idx + 24 AS forecast_idx, b.ts AS forecast_ts
    FROM r a LEFT JOIN r b ON b.series_id = a.series_id AND b.time_idx = a.time_idx + 24""",
)
def index_to_time(spark, sf_dir):
    rows = raw(spark, sf_dir).select("series_id", "time_idx", "ts")
    ahead = rows.select(
        "series_id",
        F.col("time_idx").alias("origin_idx"),
        (F.col("time_idx") + 24).alias("forecast_idx"),
    )
    return tidy(
        lookup_times(ahead, rows, "forecast_idx", "forecast_ts").select(
            "series_id", "origin_idx", "forecast_idx", "forecast_ts"
        )
    )


@query(
    "weather_encode",
    f"""
    WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL
                  ELSE {_TEXTS_SQL}[user_id % {len(WEATHER_TEXTS)} + 1] END AS txt FROM events),
    l AS (SELECT event_id, lower(txt) AS w FROM t)
    SELECT event_id,
           CAST(CASE WHEN w IS NULL THEN 5
                WHEN regexp_matches(w, 'fog|mist|haze') THEN 0
                WHEN regexp_matches(w, 'heavy|thunderstorm|storm|snow') THEN 1
                WHEN regexp_matches(w, 'rain|drizzle') THEN 2
                WHEN regexp_matches(w, 'scatter|mostly cloud') THEN 6
                WHEN regexp_matches(w, 'few cloud|partly') THEN 8
                WHEN regexp_matches(w, 'clear|sunny') THEN 10
                WHEN regexp_matches(w, 'overcast|broken|cloud') THEN 4 ELSE 5 END AS DOUBLE)
             AS weather_description
    FROM l""",
)
def weather_encode(spark, sf_dir):
    texts = F.array(*map(F.lit, WEATHER_TEXTS))
    pick = F.element_at(texts, (F.col("user_id") % len(WEATHER_TEXTS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 10 != 0, pick).alias("weather_description")
    )
    return tidy(encode_weather_text(rows))


@query(
    "null_profile",
    """
    WITH g AS (SELECT CASE WHEN event_id % 5 < 3 THEN value END AS half_gone,
                      CASE WHEN event_id % 7 <> 0 THEN value END AS some_gone,
                      CASE WHEN event_id % 5 = 0 THEN user_id END AS mostly_gone, ts
               FROM events),
    c AS (
      SELECT 'half_gone' AS column_name, 'double' AS data_type, count(*) AS total, count(*) - count(half_gone) AS missing FROM g
      UNION ALL SELECT 'some_gone', 'double', count(*), count(*) - count(some_gone) FROM g
      UNION ALL SELECT 'mostly_gone', 'bigint', count(*), count(*) - count(mostly_gone) FROM g
      UNION ALL SELECT 'ts', 'timestamp', count(*), count(*) - count(ts) FROM g)
    SELECT *, round(missing / CAST(total AS DOUBLE), 6) + 0.0 AS missing_share,
           CASE WHEN missing > 0.5 * total THEN 'critical' WHEN missing > 0.1 * total THEN 'warning'
                ELSE 'ok' END AS severity
    FROM c""",
)
def profile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 5 < 3, F.col("value")).alias("half_gone"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("some_gone"),
        F.when(F.col("event_id") % 5 == 0, F.col("user_id")).alias("mostly_gone"),
        "ts",
    )
    return tidy(null_profile(rows))


@query(
    "value_distribution",
    "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1",
)
def distribution(spark, sf_dir):
    return tidy(value_distribution(table(spark, sf_dir, "lineitem"), "l_returnflag"))


@query(
    "range_statistics",
    f"""
    WITH {EVENTS_SQL}
    SELECT series_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
           {rounded('min(pv) AS pv_min', 'max(pv) AS pv_max', 'avg(pv) AS pv_mean')},
           count(*) - count(pv) AS pv_missing
    FROM ev GROUP BY 1""",
)
def ranges(spark, sf_dir):
    return tidy(range_statistics(events(spark, sf_dir), ["pv"], ["series_id"]))


@query(
    "order_index",
    """
    WITH d AS (SELECT o_orderpriority AS series_id, o_orderdate AS ts,
                      avg(o_totalprice) / CAST(8241 AS DOUBLE) AS pv FROM orders GROUP BY 1, 2)
    SELECT series_id, ts, round(pv, 6) + 0.0 AS pv,
           row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS time_idx FROM d""",
)
def order_index(spark, sf_dir):
    """Six years of daily order values per priority."""
    daily = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"))
        .agg((F.avg("o_totalprice") / 8241).alias("pv"))
    )
    return tidy(index_hourly(daily))


@query(
    "site_local_time",
    f"""
    WITH {SITES_SQL}, {EVENTS_SQL},
    j AS (SELECT e.event_id, s.tz, e.ts, timezone(s.tz, e.ts) AS u FROM ev e JOIN sites s USING (series_id))
    SELECT event_id, tz, timezone('UTC', u) AS ts FROM j""",
)
def site_local_time(spark, sf_dir):
    """Each site's wall clock to UTC, the zone being a column (no clock change in the month)."""
    rows = with_site(events(spark, sf_dir))
    return tidy(rows.select("event_id", "tz", local_to_utc(F.col("ts"), F.col("tz")).alias("ts")))
