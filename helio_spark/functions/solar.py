"""Solar geometry and clear-sky irradiance as column expressions.

Published equations: Spencer (1971) for declination, equation of time and
extraterrestrial irradiance; Kasten and Young (1989) air mass; Haurwitz (1945),
Ineichen and Perez (2002), and the simplified Solis model of Ineichen (2008)
for clear sky. Latitude, longitude and turbidity are columns, so many sites run in
one job.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio_spark.functions.weather import to_number
from helio_spark.operators.joins import attach, require_unique
from helio_spark.operators.ordering import SERIES, TS

PI = 3.141592653589793
CLEARSKY_MODELS = ("ineichen", "simplified_solis", "haurwitz")
NIGHT_ZENITH = 90.0
RATED_KW = 82.41  # fixed value: rated power behind the normalised target


def _fourier(angle: Column, constant: float, terms: Sequence[tuple[float, float]]) -> Column:
    """constant + sum of a_k cos(k angle) + b_k sin(k angle)."""
    out = F.lit(constant)
    for k, (a, b) in enumerate(terms, start=1):
        out = out + F.lit(a) * F.cos(angle * k) + F.lit(b) * F.sin(angle * k)
    return out


# fixed values: Spencer's Fourier coefficients (cos, sin) per harmonic
DECLINATION = (0.006918, ((-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148)))
EQUATION_OF_TIME = (0.000075, ((0.001868, -0.032077), (-0.014615, -0.040849)))
SUN_DISTANCE = (1.00011, ((0.034221, 0.00128), (0.000719, 0.000077)))
SOLAR_CONSTANT = 1366.1


def in_stages(df: DataFrame, *stages: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """Add columns stage by stage and drop the helpers (all but ``keep``).

    A value used many times is a column of an earlier stage, so it is computed
    once and the generated code stays small enough to be compiled.
    """
    out = df
    for stage in stages:
        out = out.withColumns(dict(stage))
    helpers = {n for stage in stages for n in stage} - set(keep)
    return out.drop(*helpers)


def with_position(df: DataFrame, lat: Column, lon: Column, ts: str = TS) -> DataFrame:
    """``sp_zenith`` (no refraction) and ``sp_azimuth`` (from north) in degrees."""
    g, minutes, decl, phi = map(F.col, ("_day_angle", "_minutes", "_decl", "_phi"))
    hour_angle, cosz = F.col("_hour_angle"), F.col("_cosz")
    azimuth = F.degrees(
        F.atan2(
            F.sin(hour_angle), F.cos(hour_angle) * F.sin(phi) - F.tan(decl) * F.cos(phi)
        )
    )
    return in_stages(
        df,
        {
            "_minutes": F.pmod(F.unix_micros(F.col(ts)), F.lit(86_400_000_000)) / 60e6,
            "_phi": F.radians(lat),
        },
        {"_day_angle": (F.dayofyear(ts) - 1 + (minutes / 60 - 12) / 24) * F.lit(2 * PI / 365)},
        {
            "_decl": _fourier(g, *DECLINATION),
            "_eot": _fourier(g, *EQUATION_OF_TIME) * 229.18,
        },
        {"_hour_angle": F.radians((minutes + F.col("_eot") + lon * 4) / 4 - 180)},
        {
            "_cosz": F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(hour_angle),
            "sp_azimuth": F.pmod(azimuth + 180, F.lit(360.0)),
        },
        {
            # least and greatest skip NULL, so an unknown site is kept NULL here
            "sp_zenith": F.when(
                cosz.isNotNull(),
                F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosz)))),
            )
        },
        keep=("sp_zenith", "sp_azimuth"),
    )


def extraterrestrial(ts: str = TS) -> Column:
    day_angle = (F.dayofyear(ts) - 1) * F.lit(2 * PI / 365)
    return _fourier(day_angle, *SUN_DISTANCE) * SOLAR_CONSTANT


def air_mass(zenith: Column) -> Column:
    """NULL when the sun is down."""
    above = F.cos(F.radians(zenith)) + F.pow(96.07995 - zenith, F.lit(-1.6364)) * 0.50572
    return F.when(zenith < NIGHT_ZENITH, F.lit(1.0) / above)


# Each model is a list of stages over ``_z`` (cosine of the zenith), ``_i0`` and
# ``_am``; ``_ghi``, ``_dni``, ``_dhi`` are its results while the sun is up.


def _haurwitz() -> list[dict[str, Column]]:
    z = F.col("_z")
    return [{"_ghi": z * 1098.0 * F.exp(F.lit(-0.057) / z)}]


def _ineichen(altitude: Column, linke: Column) -> list[dict[str, Column]]:
    z, i0, am, ghi = map(F.col, ("_z", "_i0", "_am", "_ghi"))
    fh1, fh2 = F.exp(altitude / -8000.0), F.exp(altitude / -1250.0)
    cg1, cg2 = altitude * 5.09e-5 + 0.868, altitude * 3.92e-5 + 0.0387
    beam = i0 * (F.lit(0.163) / fh1 + 0.664) * F.exp(am * (linke - 1) * -0.09)
    rest = F.lit(1.0) - (F.lit(0.1) - F.exp(-linke) * 0.2) / (F.lit(0.882) / fh1 + 0.1)
    return [
        {"_ghi": i0 * cg1 * z * F.exp(am * (fh1 + (linke - 1) * fh2) * -cg2)},
        {"_dni": F.least(beam, ghi * rest / z)},
        {"_dhi": ghi - F.col("_dni") * z},
    ]


def _polynomial(x: float, falling: Sequence[float]) -> float:
    value = 0.0
    for c in falling:
        value = value * x + c
    return value


def _simplified_solis(altitude: Column, aod: float, water_cm: float) -> list[dict[str, Column]]:
    """``aod``: aerosol optical depth at 700 nm; ``water_cm``: precipitable water."""
    w = max(water_cm, 0.2)
    lw = math.log(w)
    # standard atmosphere: log of pressure relative to sea level
    log_p = F.log(F.pow((F.lit(44331.514) - altitude) / 11880.516, F.lit(1 / 0.1902632)) / 1013.25)
    # fixed values: fits of the model's enhanced irradiance, optical depths and exponents
    enhanced = _polynomial(aod, (0.12 * w**0.56, 0.97 * w**0.032, 1.08 * w**0.0051))
    beam_depth = _polynomial(
        aod, (1.82 + 0.056 * lw + 0.0071 * lw**2, 0.33 + 0.045 * lw + 0.0096 * lw**2)
    )
    global_depth = _polynomial(
        aod, (1.24 + 0.047 * lw + 0.0061 * lw**2, 0.27 + 0.043 * lw + 0.009 * lw**2)
    )
    if aod < 0.05:
        diffuse_depth = _polynomial(
            aod,
            (86 * w - 13800, -3.11 * w + 79.4, -0.23 * w + 74.8, 0.092 * w - 8.86, 0.0042 * w + 3.12),
        )
        diffuse_p = -0.83 * (1 + aod) ** -17.2
    else:
        diffuse_depth = _polynomial(
            aod,
            (-0.21 * w + 11.6, 0.27 * w - 20.7, -0.134 * w + 15.5, 0.0554 * w - 5.71, 0.0057 * w + 2.94),
        )
        diffuse_p = -0.71 * (1 + aod) ** -15.0
    b = (0.00925 * aod**2 + 0.0148 * aod - 0.0172) * lw - 0.7565 * aod**2 + 0.5057 * aod + 0.4557
    g = -0.0147 * lw - 0.3079 * aod**2 + 0.2846 * aod + 0.3798
    d = log_p / (18 + 152 * aod) + (-0.337 * aod**2 + 0.63 * aod + 0.116)

    z, source = F.col("_z"), F.col("_i0") * (log_p * 0.071 + enhanced)
    tau_b = log_p * (0.0089 * w + 0.13) + beam_depth
    tau_g = log_p * (0.0079 * w + 0.1) + global_depth
    tau_d = log_p * diffuse_p + diffuse_depth
    return [
        {
            "_ghi": source * F.exp(-tau_g / F.pow(z, F.lit(g))) * z,
            "_dni": source * F.exp(-tau_b / F.pow(z, F.lit(b))),
            "_dhi": source * F.exp(-tau_d / F.pow(z, d)),
        }
    ]


def with_clearsky(
    df: DataFrame,
    zenith: Column,
    turbidity: Column,
    altitude: Column | float = 0.0,
    model: str = "ineichen",
    ts: str = TS,
    aod: float = 0.1,
    water_cm: float = 1.0,
) -> DataFrame:
    """Clear-sky irradiance in W/m2, 0 while the sun is down.

    ``haurwitz`` yields ``cs_ghi`` only; the others add ``cs_dni``, ``cs_dhi``.
    """
    altitude = altitude if isinstance(altitude, Column) else F.lit(float(altitude))
    if model == "haurwitz":
        stages = _haurwitz()
    elif model == "ineichen":
        stages = _ineichen(altitude, turbidity)
    elif model == "simplified_solis":
        stages = _simplified_solis(altitude, aod, water_cm)
    else:
        raise ValueError(f"unknown clear-sky model {model!r}, use one of {CLEARSKY_MODELS}")
    day = zenith < NIGHT_ZENITH
    base = {
        "_z": F.when(day, F.cos(F.radians(zenith))),
        "_i0": F.when(day, extraterrestrial(ts)),
        "_am": air_mass(zenith),
    }
    parts = [n for n in ("ghi", "dni", "dhi") if any(f"_{n}" in stage for stage in stages)]
    out = {
        f"cs_{n}": F.when(day, F.greatest(F.col(f"_{n}"), F.lit(0.0))).when(
            zenith.isNotNull(), F.lit(0.0)
        )
        for n in parts
    }
    return in_stages(df, base, *stages, out, keep=tuple(out))


def with_coordinates(df: DataFrame, lat: float | None = None, lon: float | None = None,
                     series: str = SERIES, ts: str = TS) -> DataFrame:
    """Site coordinates ``_lat``, ``_lon``: the arguments, else each series' first
    numeric ``lat`` / ``lon`` by time."""
    given = {"lat": lat, "lon": lon}
    missing = [n for n, v in given.items() if v is None]
    absent = [n for n in missing if n not in df.columns]
    if absent:
        raise ValueError(f"no coordinates: pass {absent} or give the table such columns")
    out = df.withColumns({f"_{n}": F.lit(float(v)) for n, v in given.items() if v is not None})
    if not missing:
        return out
    first = df.groupBy(series).agg(
        *[
            F.min_by(to_number(F.col(n)), F.when(to_number(F.col(n)).isNotNull(), F.col(ts))).alias(
                f"_{n}"
            )
            for n in missing
        ]
    )
    return attach(out, first, [series], "left", spread=F.col(ts))


def add_solar_position(
    df: DataFrame, lat: float | None = None, lon: float | None = None, ts: str = TS
) -> DataFrame:
    sited = with_coordinates(df, lat, lon, ts=ts)
    return with_position(sited, F.col("_lat"), F.col("_lon"), ts).drop("_lat", "_lon")


def add_clearsky(
    df: DataFrame,
    lat: float | None = None,
    lon: float | None = None,
    altitude: float = 0.0,
    model: str = "ineichen",
    turbidity: DataFrame | float = 3.0,
    ts: str = TS,
) -> DataFrame:
    """``turbidity``: one Linke value, or a table ``(month, tl)`` of twelve rows."""
    had = "sp_zenith" in df.columns
    out = df if had else add_solar_position(df, lat, lon, ts)
    if isinstance(turbidity, DataFrame):
        require_unique(turbidity, ["month"], "the turbidity table")  # so at most twelve rows of months that occur
        monthly = F.broadcast(turbidity.where("month BETWEEN 1 AND 12").select(F.col("month").alias("_month"), F.col("tl").alias("_tl")))
        out = out.join(monthly, F.month(ts) == F.col("_month"), "left")
    else:
        out = out.withColumns({"_month": F.lit(0), "_tl": F.lit(float(turbidity))})
    out = with_clearsky(out, F.col("sp_zenith"), F.col("_tl"), altitude, model, ts)
    out = out.drop("_month", "_tl")
    return out if had else out.drop("sp_zenith", "sp_azimuth")


def turbidity_at(months: Column, ts: Column) -> Column:
    """The Linke value of ``ts`` on straight lines between the centres of the months.

    ``months`` holds the values of January to December; the year closes on itself.
    """
    days, start = F.dayofmonth(F.last_day(ts)), F.trunc(ts, "month")
    before, after = F.dayofmonth(F.date_sub(start, 1)), F.dayofmonth(F.last_day(F.add_months(start, 1)))
    seconds = F.unix_micros(ts) - F.unix_micros(start.cast("timestamp"))
    place = seconds / 86_400_000_000.0 - days / 2.0  # days from the centre of the month
    month = F.month(ts)
    at = lambda m: F.get(months, F.pmod(m - 1, F.lit(12)))
    late = place / ((days + after) / 2.0)
    early = -place / ((days + before) / 2.0)
    return F.when(place >= 0, at(month) * (F.lit(1.0) - late) + at(month + 1) * late).otherwise(
        at(month) * (F.lit(1.0) - early) + at(month - 1) * early
    )


def add_clearsky_by_site(
    df: DataFrame,
    sites: DataFrame,
    turbidity: DataFrame | None = None,
    model: str = "ineichen",
    interpolate: bool = True,
    default_turbidity: float = 3.0,
    series: str = SERIES,
    ts: str = TS,
) -> DataFrame:
    """Sun position and clear sky of each row at its own site.

    ``sites``: (series, lat, lon, altitude in m), one row for each series, null altitudes are sea
    level. ``turbidity``: (series, month, tl), a row for each month of a series that it names; on lines between
    the centres of the months, or as steps. A series without turbidity has ``default_turbidity``, one
    without a site has null results. Both tables become one row for each series, which is broadcast
    if it is small and else joined by series with salted keys.
    """
    require_unique(sites, [series], "the site table")
    known = sites.select(
        series, F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"),
        F.coalesce(F.col("altitude").cast("double"), F.lit(0.0)).alias("_altitude"),
    )
    plain = F.array_repeat(F.lit(float(default_turbidity)), 12)
    if turbidity is None:
        known = known.withColumn("_months", plain)
    else:
        require_unique(turbidity, [series, "month"], "the turbidity table")
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("month", F.col("tl").cast("double").alias("tl")))), lambda x: x["tl"])
        bad = F.raise_error(F.lit("turbidity needs the months 1 to 12 of each series it names")).cast("array<double>")
        whole = (F.count(F.lit(1)) == 12) & (F.min("month") == 1) & (F.max("month") == 12) & (F.count("tl") == 12)
        monthly = turbidity.groupBy(series).agg(F.when(whole, ordered).otherwise(bad).alias("_own"))
        known = known.join(monthly, series, "left").withColumn("_months", F.coalesce("_own", plain)).drop("_own")
    placed = attach(df, known, [series], "left", spread=F.col(ts))
    linke = turbidity_at(F.col("_months"), F.col(ts)) if interpolate else F.get("_months", F.month(ts) - 1)
    out = with_position(placed, F.col("_lat"), F.col("_lon"), ts).withColumn("_tl", linke)
    return with_clearsky(out, F.col("sp_zenith"), F.col("_tl"), F.col("_altitude"), model, ts).drop(
        "_lat", "_lon", "_altitude", "_months", "_tl"
    )


def clearness(ghi: Column, cs_ghi: Column) -> Column:
    """ghi / cs_ghi clipped to [0, 2]; NULL without clear-sky light or without ghi."""
    ratio = F.when((cs_ghi > 0) & ghi.isNotNull(), ghi / cs_ghi)
    return F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(2.0)))


def add_clearness(df: DataFrame, ghi: str = "ghi", fill: float | None = None) -> DataFrame:
    """``kc``; ``fill`` replaces NULL (0 for nights)."""
    if ghi not in df.columns or "cs_ghi" not in df.columns:
        return df
    kc = clearness(F.col(ghi), F.col("cs_ghi"))
    return df.withColumn("kc", kc if fill is None else F.coalesce(kc, F.lit(fill)))


def is_night(zenith: Column) -> Column:
    return zenith > NIGHT_ZENITH


def to_kw(normalised: Column, rated: float = RATED_KW) -> Column:
    return normalised * rated


def raw_solar_weight(zenith: Column, gamma: float = 1.0, floor: float = 0.1) -> Column:
    daylight = F.greatest(F.cos(F.radians(zenith)), F.lit(0.0))
    return F.when(zenith.isNotNull(), F.pow(daylight, F.lit(gamma)) + floor)


def add_solar_weights(
    df: DataFrame,
    scope: Sequence[str] = (),
    where: Column | None = None,
    gamma: float = 1.0,
    floor: float = 0.1,
    zenith: str = "sp_zenith",
    name: str = "weight",
    spread: Column | None = None,
) -> DataFrame:
    """Solar weights divided by their mean.

    ``scope`` names the columns within which the mean is taken (none: all rows);
    ``where`` restricts the rows that enter it (such as the train rows).
    """
    raw = raw_solar_weight(F.col(zenith), gamma, floor)
    weighted = df.withColumn("_raw", raw)
    base = F.col("_raw") if where is None else F.when(where, F.col("_raw"))
    mean = F.avg(base).alias("_mean")
    if not scope:
        return weighted.withColumn(name, F.col("_raw") / weighted.agg(mean).scalar()).drop("_raw")
    means = weighted.groupBy(*scope).agg(mean)
    joined = attach(weighted, means, list(scope), "left", spread=spread)
    return joined.withColumn(name, F.col("_raw") / F.col("_mean")).drop("_raw", "_mean")
