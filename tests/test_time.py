from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from helio_spark.functions.time import (
    require_parsable,
    add_calendar_flags,
    add_cyclic,
    local_to_utc,
    parse_utc,
    parse_utc_strict,
    split_unparsable,
)


def _utc(spark, texts, tz, shift=60):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ts = local_to_utc(F.col("t").cast("timestamp_ntz"), tz, shift).cast("timestamp_ntz")
    return [r[0] for r in df.select(ts).collect()]


def test_clock_changes_known_values(spark):
    cases = {
        "2010-10-03 02:30:00": "2010-10-02 16:00:00",  # does not exist
        "2011-04-03 02:30:00": "2011-04-02 16:30:00",  # occurs twice
        "2011-04-03 01:30:00": "2011-04-02 14:30:00",
        "2010-07-01 16:59:59.985": "2010-07-01 06:59:59.985",
    }
    got = _utc(spark, list(cases), "Australia/Sydney")
    assert got == [dt.datetime.fromisoformat(v) for v in cases.values()]


def _expected(local: dt.datetime, zone: ZoneInfo) -> dt.datetime:
    """Standard time if ambiguous, the end of the gap if nonexistent."""
    later = local.replace(tzinfo=zone, fold=1)
    as_utc = later.astimezone(dt.timezone.utc)
    if as_utc.astimezone(zone).replace(tzinfo=None) == local:
        return as_utc.replace(tzinfo=None)
    step = as_utc - dt.timedelta(hours=3)
    before = step.astimezone(zone).utcoffset()
    while step.astimezone(zone).utcoffset() == before:
        step += dt.timedelta(minutes=1)
    return step.replace(tzinfo=None)


@pytest.mark.parametrize(
    "zone,shift,days",
    [
        ("Australia/Sydney", 60, ["2010-10-03", "2011-04-03"]),
        ("Australia/Adelaide", 60, ["2010-10-03", "2011-04-03"]),
        ("Australia/Lord_Howe", 30, ["2010-10-03", "2011-04-03"]),
        ("Europe/Rome", 60, ["2024-03-31", "2024-10-27"]),
        ("America/New_York", 60, ["2024-03-10", "2024-11-03"]),
    ],
)
def test_clock_changes_by_minute(spark, zone, shift, days):
    locals_ = [
        dt.datetime.fromisoformat(d) + dt.timedelta(minutes=10 * i) for d in days for i in range(40)
    ]
    got = _utc(spark, [str(t) for t in locals_], zone, shift)
    assert got == [_expected(t, ZoneInfo(zone)) for t in locals_]


def test_offsets_and_quarantine(spark):
    df = spark.createDataFrame(
        [("2020-01-01T12:00:00+10:00",), ("2020-01-01 12:00:00",), ("soon",), (None,)], "t string"
    )
    good, bad = split_unparsable(df, "t")
    assert sorted(str(r.ts) for r in good.select(F.col("ts").cast("timestamp_ntz").alias("ts")).collect()) == [
        "2020-01-01 02:00:00",
        "2020-01-01 12:00:00",
    ]
    assert bad.count() == 2
    with pytest.raises(Exception, match="unparsable timestamp: (soon|NULL)"):
        df.select(parse_utc_strict(F.col("t"))).collect()
    many = spark.range(40).select(F.concat(F.lit("bad"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("t"))
    for parts in (1, 7):  # the same message for any split of the rows
        with pytest.raises(ValueError, match="bad00, bad01, bad02, bad03, bad04, [.]{3}$"):
            require_parsable(many.repartition(parts), "t")
    require_parsable(good, "t")
    assert df.select(parse_utc(F.col("t")).alias("x")).where("x is null").count() == 2


def test_cyclic_on_the_circle(spark):
    df = spark.range(24 * 400).select((F.lit("2020-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("ts"))
    out = add_cyclic(df)
    off = out.select(
        F.max(F.abs(F.col("hour_sin") ** 2 + F.col("hour_cos") ** 2 - 1)),
        F.max(F.abs(F.col("doy_sin") ** 2 + F.col("doy_cos") ** 2 - 1)),
    ).first()
    assert max(off) < 1e-12


def test_calendar_flags(spark):
    df = spark.sql("select timestamp'2024-01-06 23:00:00' ts union all select timestamp'2024-01-01 05:00:00'")
    days = spark.sql("select date'2024-01-01' day union all select date'2024-01-01'")
    rows = {str(r.ts)[:10]: (r.is_weekend, r.is_holiday) for r in add_calendar_flags(df, days).collect()}
    assert rows == {"2024-01-06": (1.0, 0.0), "2024-01-01": (0.0, 1.0)}
    assert {r.is_holiday for r in add_calendar_flags(df).collect()} == {0.0}
