"""Solar, clear-sky, weight and whole-chain feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helio_spark.catalog.inputs import (
    EVENTS_SQL,
    HOURLY_SQL,
    SITES_SQL,
    WEATHER_SQL,
    events,
    hourly_plain,
    rounded,
    sites,
    tidy,
    weather,
    with_site,
)
from helio_spark.catalog.registry import query
from helio_spark.functions.solar import (
    add_clearness,
    add_clearsky,
    add_clearsky_by_site,
    add_solar_position,
    add_solar_weights,
    is_night,
    to_kw,
    with_coordinates,
)
from helio_spark.operators.history import DEFAULT_LAGS, DEFAULT_ROLLS
from helio_spark.plans.features import build_features, build_scoring_features

# fixed values: sample Linke turbidity by month
TURBIDITY = (2.8, 2.9, 3.1, 3.3, 3.5, 3.6, 3.6, 3.5, 3.3, 3.1, 2.9, 2.8)


def solar_sql(source: str) -> str:
    """CTEs ``sun``: the columns of ``source`` (with ts, lat, lon) plus sun angles."""
    return f"""
    s1 AS (SELECT *, (epoch_us(ts) % 86400000000) / 60e6 AS mi FROM {source}),
    s2 AS (SELECT *, 2 * pi() / 365 * (dayofyear(ts) - 1 + (mi / 60 - 12) / 24) AS g,
                  2 * pi() / 365 * (dayofyear(ts) - 1) AS gd FROM s1),
    s3 AS (SELECT *, radians(lat) AS phi,
             0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g)
               + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl,
             229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g)
               - 0.040849 * sin(2 * g)) AS eot,
             1366.1 * (1.00011 + 0.034221 * cos(gd) + 0.00128 * sin(gd) + 0.000719 * cos(2 * gd)
               + 0.000077 * sin(2 * gd)) AS i0
           FROM s2),
    s4 AS (SELECT *, radians((mi + eot + 4 * lon) / 4 - 180) AS ha FROM s3),
    sun AS (SELECT *,
             degrees(acos(greatest(-1.0, least(1.0, sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(ha)))))
               AS sp_zenith,
             (degrees(atan2(sin(ha), cos(ha) * sin(phi) - tan(decl) * cos(phi))) + 180 + 360) % 360
               AS sp_azimuth
           FROM s4)"""


_SITED_SQL = f"{SITES_SQL}, {EVENTS_SQL}, se AS (SELECT * FROM ev JOIN sites USING (series_id))"


def _sited(spark, sf_dir):
    return with_site(events(spark, sf_dir)).drop("tz")


@query(
    "site_coordinates",
    f"""
    WITH {_SITED_SQL},
    f AS (SELECT series_id, arg_min(lat + user_id / 1000.0::DOUBLE, ts) AS _lat FROM se
          WHERE event_id % 3 <> 0 GROUP BY 1)
    SELECT event_id, round(_lat, 6) + 0.0 AS lat, CAST(10 AS DOUBLE) AS lon
    FROM se JOIN f USING (series_id)""",
)
def site_coordinates(spark, sf_dir):
    """First numeric latitude per series; the longitude is given."""
    text = F.when(F.col("event_id") % 3 == 0, "unknown").otherwise(
        (F.col("lat") + F.col("user_id") / 1000.0).cast("string")
    )
    found = with_coordinates(_sited(spark, sf_dir).withColumn("lat", text), lon=10.0)
    return tidy(found.select("event_id", F.col("_lat").alias("lat"), F.col("_lon").alias("lon")))


@query(
    "solar_position",
    f"WITH {_SITED_SQL}, {solar_sql('se')} "
    f"SELECT event_id, ts, {rounded('sp_zenith', 'sp_azimuth')} FROM sun",
)
def solar_position(spark, sf_dir):
    placed = add_solar_position(_sited(spark, sf_dir))
    return tidy(placed.select("event_id", "ts", "sp_zenith", "sp_azimuth"))


@query(
    "night_and_kw",
    f"WITH {_SITED_SQL}, {solar_sql('se')} "
    f"SELECT event_id, sp_zenith > 90 AS is_night, {rounded('pv * 82.41 AS kw')} FROM sun",
)
def night_and_kw(spark, sf_dir):
    placed = add_solar_position(_sited(spark, sf_dir))
    return tidy(
        placed.select(
            "event_id", is_night(F.col("sp_zenith")).alias("is_night"), to_kw(F.col("pv")).alias("kw")
        )
    )


@query(
    "clearsky_haurwitz",
    f"""
    WITH {_SITED_SQL}, {solar_sql('se')}, c AS (SELECT *, cos(radians(sp_zenith)) AS z FROM sun)
    SELECT event_id, ts,
           {rounded('CASE WHEN sp_zenith < 90 THEN 1098 * z * exp(-0.057 / z) ELSE 0 END AS cs_ghi')}
    FROM c""",
)
def clearsky_haurwitz(spark, sf_dir):
    return tidy(
        add_clearsky(_sited(spark, sf_dir), model="haurwitz").select("event_id", "ts", "cs_ghi")
    )


_TURBIDITY_SQL = "tu(mo, tl) AS (VALUES " + ", ".join(
    f"({m}, CAST({t} AS DOUBLE))" for m, t in enumerate(TURBIDITY, start=1)
) + ")"

# altitude 100 m
_INEICHEN_SQL = """
    c AS (SELECT *, cos(radians(sp_zenith)) AS z, exp(-100 / 8000.0::DOUBLE) AS fh1,
                 exp(-100 / 1250.0::DOUBLE) AS fh2, 5.09e-5 * 100 + 0.868 AS cg1,
                 3.92e-5 * 100 + 0.0387 AS cg2
          FROM {source}),
    a AS (SELECT *, CASE WHEN sp_zenith < 90
             THEN 1 / (z + 0.50572 * pow(96.07995 - sp_zenith, -1.6364)) END AS am FROM c),
    gh AS (SELECT *, cg1 * i0 * z * exp(-cg2 * am * (fh1 + fh2 * (tl - 1))) AS raw_ghi FROM a),
    dn AS (SELECT *, least((0.664 + 0.163 / fh1) * i0 * exp(-0.09 * am * (tl - 1)),
                       raw_ghi * (1 - (0.1 - 0.2 * exp(-tl)) / (0.1 + 0.882 / fh1)) / z) AS raw_dni
           FROM gh),
    cs AS (SELECT *, CASE WHEN sp_zenith < 90 THEN greatest(raw_ghi, 0) ELSE 0 END AS cs_ghi,
                  CASE WHEN sp_zenith < 90 THEN greatest(raw_dni, 0) ELSE 0 END AS cs_dni,
                  CASE WHEN sp_zenith < 90 THEN greatest(raw_ghi - raw_dni * z, 0) ELSE 0 END AS cs_dhi
           FROM dn)"""


@query(
    "clearsky_ineichen",
    f"""
    WITH {_SITED_SQL}, {solar_sql('se')}, {_TURBIDITY_SQL},
    t AS (SELECT * FROM sun JOIN tu ON mo = month(ts)), {_INEICHEN_SQL.format(source='t')}
    SELECT event_id, ts, {rounded('cs_ghi', 'cs_dni', 'cs_dhi')} FROM cs""",
)
def clearsky_ineichen(spark, sf_dir):
    monthly = spark.createDataFrame(
        list(enumerate(TURBIDITY, start=1)), "month int, tl double"
    )
    sky = add_clearsky(_sited(spark, sf_dir), altitude=100.0, turbidity=monthly)
    return tidy(sky.select("event_id", "ts", "cs_ghi", "cs_dni", "cs_dhi"))


# three altitudes; turbidity of its own for the first three series, 3 for the others
ALTITUDES = {"click": 0.0, "error": 750.0, "purchase": 2400.0, "signup": None, "view": 750.0}
_BY_SITE_SQL = f"""
    places(series_id, alt, k) AS (VALUES {', '.join(f"('{s}', CAST({a or 0} AS DOUBLE), {i})" for i, (s, a) in enumerate(ALTITUDES.items()))}),
    tm AS (SELECT k, tl, mo, CASE WHEN k < 3 THEN tl + 0.2 * k ELSE 3.0 END AS v FROM tu CROSS JOIN (SELECT DISTINCT k FROM places)),
    dt AS (
      SELECT *, month(ts) AS mo, day(last_day(ts)) AS len, day(CAST(date_trunc('month', ts) AS DATE) - 1) AS len0,
             day(last_day(CAST(date_trunc('month', ts) AS DATE) + INTERVAL 1 MONTH)) AS len1,
             (epoch_us(ts) - epoch_us(CAST(date_trunc('month', ts) AS TIMESTAMP))) / 86400000000.0::DOUBLE - day(last_day(ts)) / 2.0::DOUBLE AS p
      FROM sun JOIN places USING (series_id)),
    t AS (
      SELECT dt.*, CASE WHEN p >= 0 THEN a.v * (1 - p / ((len + len1) / 2.0::DOUBLE)) + c.v * (p / ((len + len1) / 2.0::DOUBLE))
                        ELSE a.v * (1 + p / ((len + len0) / 2.0::DOUBLE)) - b.v * (p / ((len + len0) / 2.0::DOUBLE)) END AS tl
      FROM dt JOIN tm a ON a.k = dt.k AND a.mo = dt.mo JOIN tm b ON b.k = dt.k AND b.mo = (dt.mo + 10) % 12 + 1
      JOIN tm c ON c.k = dt.k AND c.mo = dt.mo % 12 + 1)"""


@query(
    "clearsky_by_site",
    f"""
    WITH {_SITED_SQL}, {solar_sql('se')}, {_TURBIDITY_SQL}, {_BY_SITE_SQL},
    {_INEICHEN_SQL.format(source='t').replace('-100 /', '-alt /').replace('* 100 +', '* alt +')}
    SELECT event_id, ts, {rounded('cs_ghi', 'cs_dni', 'cs_dhi')} FROM cs""",
)
def clearsky_by_site(spark, sf_dir):
    """Each series at its own altitude, with turbidity between the centres of the months."""
    places = sites(spark).drop("tz")
    high = spark.createDataFrame(list(ALTITUDES.items()), "series_id string, altitude double")
    own = [(s, m, tl + 0.2 * k) for k, s in enumerate(list(ALTITUDES)[:3]) for m, tl in enumerate(TURBIDITY, start=1)]
    monthly = spark.createDataFrame(own, "series_id string, month int, tl double")
    rows = events(spark, sf_dir).select("event_id", "series_id", "ts")
    sky = add_clearsky_by_site(rows, places.join(high, "series_id"), monthly)
    return tidy(sky.select("event_id", "ts", "cs_ghi", "cs_dni", "cs_dhi"))


# aerosol depth 0.1, water 1 cm (its logarithm is 0), altitude 100 m
_SOLIS_SQL = """
    p AS (SELECT *, cos(radians(sp_zenith)) AS z,
                 ln(pow((44331.514 - 100) / 11880.516, 1 / 0.1902632) / 1013.25) AS lp FROM sun),
    k AS (SELECT *, i0 * (0.12 * 0.01 + 0.97 * 0.1 + 1.08 + 0.071 * lp) AS ie,
                 1.82 * 0.1 + 0.33 + (0.0089 + 0.13) * lp AS tb,
                 1.24 * 0.1 + 0.27 + (0.0079 + 0.1) * lp AS tg,
                 (-0.21 + 11.6) * pow(0.1, 4) + (0.27 - 20.7) * pow(0.1, 3) + (-0.134 + 15.5) * 0.01
                   + (0.0554 - 5.71) * 0.1 + 0.0057 + 2.94 - 0.71 * pow(1.1, -15) * lp AS td,
                 -0.7565 * 0.01 + 0.5057 * 0.1 + 0.4557 AS eb,
                 -0.3079 * 0.01 + 0.2846 * 0.1 + 0.3798 AS eg,
                 -0.337 * 0.01 + 0.63 * 0.1 + 0.116 + lp / (18 + 152 * 0.1) AS ed
          FROM p)"""


@query(
    "clearsky_solis",
    f"""
    WITH {_SITED_SQL}, {solar_sql('se')}, {_SOLIS_SQL}
    SELECT event_id, ts, """
    + rounded(
        "CASE WHEN sp_zenith < 90 THEN ie * exp(-tg / pow(z, eg)) * z ELSE 0 END AS cs_ghi",
        "CASE WHEN sp_zenith < 90 THEN ie * exp(-tb / pow(z, eb)) ELSE 0 END AS cs_dni",
        "CASE WHEN sp_zenith < 90 THEN ie * exp(-td / pow(z, ed)) ELSE 0 END AS cs_dhi",
    )
    + " FROM k",
)
def clearsky_solis(spark, sf_dir):
    sky = add_clearsky(_sited(spark, sf_dir), altitude=100.0, model="simplified_solis")
    return tidy(sky.select("event_id", "ts", "cs_ghi", "cs_dni", "cs_dhi"))


_CLEARNESS = """
    SELECT event_id, ts, {kc}
    FROM (SELECT *, CASE WHEN cs > 0 AND ghi IS NOT NULL
                         THEN least(greatest(ghi / cs, 0), 2) END AS kc
          FROM (SELECT *, CASE WHEN event_id % 6 <> 0 THEN value * 3 END AS ghi,
                       CASE WHEN sp_zenith < 90
                            THEN 1098 * cos(radians(sp_zenith)) * exp(-0.057 / cos(radians(sp_zenith)))
                            ELSE 0 END AS cs FROM sun))"""


@query(
    "clearness",
    f"WITH {_SITED_SQL}, {solar_sql('se')} "
    + _CLEARNESS.format(kc=rounded("kc", "coalesce(kc, 0) AS kc_filled")),
)
def clearness(spark, sf_dir):
    ghi = F.when(F.col("event_id") % 6 != 0, F.col("value") * 3)
    sky = add_clearsky(_sited(spark, sf_dir).withColumn("ghi", ghi), model="haurwitz")
    both = add_clearness(sky).withColumnRenamed("kc", "_kc")
    both = add_clearness(both, fill=0.0).select(
        "event_id", "ts", F.col("_kc").alias("kc"), F.col("kc").alias("kc_filled")
    )
    return tidy(both)


_RAW_WEIGHT = "pow(greatest(cos(radians(sp_zenith)), 0), {g}) + 0.1"


@query(
    "solar_weights",
    f"""
    WITH {_SITED_SQL}, {solar_sql('se')},
    w AS (SELECT event_id, series_id, {_RAW_WEIGHT.format(g='1.0')} AS a,
                 {_RAW_WEIGHT.format(g='1.5')} AS b FROM sun)
    SELECT event_id, {rounded(
        'a / avg(a) OVER () AS weight', 'b / avg(b) OVER (PARTITION BY series_id) AS weight_series')}
    FROM w""",
)
def solar_weights(spark, sf_dir):
    """Mean over all rows, and with exponent 1.5 over each series."""
    placed = add_solar_position(_sited(spark, sf_dir))
    whole = add_solar_weights(placed)
    both = add_solar_weights(
        whole, scope=["series_id"], gamma=1.5, name="weight_series", spread=F.col("event_id")
    )
    return tidy(both.select("event_id", "weight", "weight_series"))


_WITH_HISTORY = ("pv", "ghi")
_LAG_NAMES = [f"{c}_lag{n}" for c in _WITH_HISTORY for n in DEFAULT_LAGS]
_ROLL_NAMES = [f"{c}_{kind}{n}h" for c in _WITH_HISTORY for kind in ("roll", "var") for n in DEFAULT_ROLLS]
_FEATURE_COLS = (
    "series_id", "ts", "time_idx", "pv", "ghi", "temp", "weather_description", "hour_sin", "hour_cos", "doy_sin", "doy_cos",
    "is_weekend", "is_holiday", "sp_zenith", "sp_azimuth", "cs_ghi", "cs_dni", "cs_dhi", "kc", *_LAG_NAMES, *_ROLL_NAMES,
)


_WIN = "PARTITION BY series_id ORDER BY ts"


def _history_sql() -> list[str]:
    """All lags, rolling means and variances of the default widths."""
    out = [f"lag({c}, {n}) OVER ({_WIN}) AS {c}_lag{n}" for c in _WITH_HISTORY for n in DEFAULT_LAGS]
    for c in _WITH_HISTORY:
        for kind, agg in (("roll", "avg"), ("var", "var_pop")):
            for n in DEFAULT_ROLLS:
                frame = f"({_WIN} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
                out.append(f"CASE WHEN count({c}) OVER {frame} >= {max(1, n // 2)} THEN {agg}({c}) OVER {frame} END AS {c}_{kind}{n}h")
    return out


_CHAIN_SQL = f"""
    WITH {WEATHER_SQL}, {SITES_SQL}, {EVENTS_SQL},
    al AS (SELECT coalesce(e.series_id, w.series_id) AS series_id, coalesce(e.ts, w.ts) AS ts, e.pv,
                  w.ghi, w.temp, CASE WHEN w.ghi > 300 THEN 'clear sky' WHEN w.ghi IS NOT NULL
                                      THEN 'light rain' END AS txt
           FROM ev e FULL JOIN wx w ON w.series_id = e.series_id AND w.ts = e.ts),
    ff AS (SELECT series_id, ts, pv, last_value(ghi IGNORE NULLS) OVER w AS ghi,
                  last_value(temp IGNORE NULLS) OVER w AS temp,
                  last_value(txt IGNORE NULLS) OVER w AS txt
           FROM al WINDOW w AS ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    st AS (SELECT f.*, lat, lon, CAST(3.0 AS DOUBLE) AS tl
           FROM ff f JOIN sites USING (series_id) WHERE pv IS NOT NULL),
    {solar_sql('st')},
    {_INEICHEN_SQL.format(source='sun').replace('-100 /', '-0.0 /').replace('* 100 +', '* 0 +')},
    fe AS (SELECT *, coalesce(CASE WHEN cs_ghi > 0 THEN least(greatest(ghi / cs_ghi, 0), 2) END, 0) AS kc,
             CAST(CASE txt WHEN 'clear sky' THEN 10 WHEN 'light rain' THEN 2 ELSE 5 END AS DOUBLE)
               AS weather_description,
             sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
             sin(2 * pi() * dayofyear(ts) / 365) AS doy_sin, cos(2 * pi() * dayofyear(ts) / 365) AS doy_cos,
             CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS DOUBLE) AS is_weekend,
             CAST(0 AS DOUBLE) AS is_holiday, {', '.join(_history_sql())}
           FROM cs)
    SELECT series_id, ts, row_number() OVER ({_WIN}) - 1 AS time_idx,
           {rounded(*_FEATURE_COLS[3:])}
    FROM fe WHERE ghi IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in (*_LAG_NAMES, *_ROLL_NAMES))}"""


@query("feature_table", _CHAIN_SQL)
def feature_table(spark, sf_dir):
    """The whole chain: as-of weather, row features, history, cleaning, new index."""
    text = F.when(F.col("ghi") > 300, "clear sky").otherwise("light rain")
    wx = with_site(weather(spark, sf_dir).withColumn("weather_description", text)).drop("tz")
    built = build_features(events(spark, sf_dir), wx)
    return tidy(built.select(*_FEATURE_COLS))


@query(
    "scoring_features",
    f"""
    WITH {HOURLY_SQL}, {SITES_SQL},
    me AS (SELECT series_id, ts, pv FROM hp WHERE n < 4),
    w AS (SELECT series_id, ts, ghi FROM hp
          UNION ALL SELECT series_id, ts + INTERVAL 30 DAY, ghi / 2 FROM hp),
    al AS (SELECT w.series_id, w.ts, pv, ghi FROM w LEFT JOIN me USING (series_id, ts))
    SELECT series_id, ts, row_number() OVER ({_WIN}) - 1 AS time_idx, """
    + rounded(
        "pv",
        "ghi",
        *_history_sql(),
    )
    + " FROM al",
)
def scoring_features(spark, sf_dir):
    """History and a month of future weather; rows without a measurement stay."""
    base = with_site(hourly_plain(spark, sf_dir)).drop("tz")
    measured = base.where(F.col("n") < 4).select("series_id", "ts", "pv")
    past = base.select("series_id", "ts", F.col("ghi").alias("Ghi"), "lat", "lon")
    ahead = base.select(
        "series_id",
        (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
        (F.col("ghi") / 2).alias("ghi"),
        "lat",
        "lon",
    )
    built = build_scoring_features(measured, past, ahead)
    return tidy(built.select("series_id", "ts", "time_idx", "pv", "ghi", *_LAG_NAMES, *_ROLL_NAMES))
