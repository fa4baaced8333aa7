from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helio_spark.operators import joins
from helio_spark.operators.align import align
from helio_spark.operators.clean import dedupe_first
from helio_spark.operators.joins import attach
from helio_spark.operators.ordering import index_cells, index_hourly, index_rows, range_slices, reindex


def _skewed(spark, n=20_000):
    """One series with two thirds of the rows, most of them within one hour."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 < 2, "hot").when(i % 3 == 2, F.concat(F.lit("s"), (i % 50).cast("string"))).alias("series_id"),
        F.timestamp_micros(
            F.when(i % 10 < 8, F.pmod(F.xxhash64(i), F.lit(3_600_000_000))).otherwise(
                F.pmod(F.xxhash64(i), F.lit(10**13))
            )
        ).alias("ts"),
        i.alias("event_id"),
    )


def _plain_index(df):
    w = Window.partitionBy("series_id").orderBy("ts", "event_id")
    return df.withColumn("time_idx", (F.row_number().over(w) - 1).cast("long"))


@pytest.mark.parametrize("slices", [None, 1, 7, 32])
def test_index_rows_equals_plain_numbering(spark, slices):
    df = _skewed(spark)
    got = index_rows(df, ties=("event_id",), slices=slices).select("series_id", "ts", "event_id", "time_idx")
    assert got.exceptAll(_plain_index(df)).count() == 0
    assert got.count() == df.count()


def test_hot_series_is_spread_over_slices(spark):
    laid = range_slices(_skewed(spark), order=("ts", "event_id"), slices=20)
    sizes = [r["count"] for r in laid.groupBy("_slice").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3 * 1000
    hot = laid.where("series_id = 'hot'").select("_slice").distinct().count()
    assert hot >= 12


def test_one_instant_with_many_rows_is_spread(spark):
    df = spark.range(9_000).select(
        F.lit("a").alias("series_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("id").alias("event_id")
    )
    laid = range_slices(df, order=("ts", "event_id"), slices=9)
    assert max(r["count"] for r in laid.groupBy("_slice").count().collect()) < 3_000


def test_index_cells_and_reindex(spark):
    df = _skewed(spark, 3000)
    by_day = index_cells(df, F.to_date("ts"), order=("ts", "event_id"))
    assert by_day.select("series_id", "ts", "event_id", "time_idx").exceptAll(_plain_index(df)).count() == 0
    kept = by_day.where(F.col("event_id") % 7 != 0)
    again = reindex(kept).select("series_id", "ts", "event_id", "time_idx")
    assert again.exceptAll(_plain_index(kept.drop("time_idx"))).count() == 0


def test_index_hourly_is_dense(spark):
    df = spark.range(500).select(
        F.lit("a").alias("series_id"),
        F.timestamp_seconds(F.col("id") * 3 * 3600).alias("ts"),
    )
    got = sorted(r.time_idx for r in index_hourly(df).collect())
    assert got == list(range(500))


def test_attach_beyond_the_broadcast_size(spark):
    df = _skewed(spark, 5000)
    stats = df.groupBy("series_id").agg(F.max("ts").alias("last"))
    small = attach(df, stats, ["series_id"])
    salted = attach(df, stats, ["series_id"], spread=F.col("event_id"), broadcast_rows=0, salts=8)
    plain = attach(df, stats, ["series_id"], broadcast_rows=0)
    assert small.exceptAll(salted).count() == 0 and salted.count() == 5000
    assert small.exceptAll(plain).count() == 0
    assert "_salt" not in salted.columns


def test_dedupe_keeps_the_first_of_many_copies(spark):
    rows = spark.range(10_000).select(
        F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("series_id"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"),
        (F.col("id") % 5).alias("part_no"),
        F.col("id").alias("row_no"),
        F.when(F.col("id") > 0, F.col("id") * 1.0).alias("pv"),
    )
    got = dedupe_first(rows)
    assert got.count() == 10_000 - 3334 + 1
    first = got.where("series_id = 'copy'").first()
    assert (first.part_no, first.row_no, first.pv) == (0, 0, None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan


def _pandas_align(measured, weather, keep_future):
    out = []
    for s in sorted(set(measured.series_id) | set(weather.series_id)):
        m = measured[measured.series_id == s].set_index("ts")[["pv"]]
        w = weather[weather.series_id == s].set_index("ts")[["ghi", "temp"]]
        j = m.join(w, how="outer").sort_index()
        j[["ghi", "temp"]] = j[["ghi", "temp"]].ffill()
        if not keep_future:
            j = j[j.pv.notna()]
        j["series_id"], j["time_idx"] = s, np.arange(len(j))
        out.append(j.reset_index())
    return pd.concat(out)


@pytest.mark.parametrize("slices", [1, 5, 16])
@pytest.mark.parametrize("keep_future", [False, True])
def test_align_equals_outer_join_and_fill(spark, slices, keep_future):
    rng = np.random.default_rng(1)

    def times(n):
        return pd.to_datetime(rng.choice(5000, n, replace=False) * 10**9 * 60)

    measured = pd.concat(
        pd.DataFrame({"series_id": s, "ts": times(n), "pv": rng.random(n)}) for s, n in (("a", 900), ("b", 40))
    )
    measured.loc[rng.random(len(measured)) < 0.1, "pv"] = np.nan
    weather = pd.concat(
        pd.DataFrame({"series_id": s, "ts": times(n), "ghi": rng.random(n), "temp": rng.random(n)})
        for s, n in (("a", 60), ("b", 30), ("c", 5))
    )
    weather.loc[rng.random(len(weather)) < 0.6, "temp"] = np.nan

    def frame(p):
        df = spark.createDataFrame(p)
        return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else c for c, t in df.dtypes])

    got = align(frame(measured), frame(weather), keep_future=keep_future, slices=slices).toPandas()
    want = _pandas_align(measured, weather, keep_future)
    cols = ["series_id", "ts", "pv", "ghi", "temp", "time_idx"]
    got = got[cols].sort_values(["series_id", "ts"]).reset_index(drop=True)
    want = want[cols].sort_values(["series_id", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_align_without_overlap(spark):
    m = spark.sql("select 'a' series_id, timestamp'2024-01-01' ts, 1.0D pv")
    w = spark.sql("select 'a' series_id, timestamp'2025-01-01' ts, 2.0D ghi")
    row = align(m, w).collect()
    assert len(row) == 1 and row[0].ghi is None
    assert align(m, w, keep_future=True).count() == 2


def test_index_blocks_needs_no_second_exchange(spark):
    from helio_spark.operators.history import add_lags
    from helio_spark.operators.ordering import index_blocks
    from helio_spark.session import materialize

    df = _plain_index(_skewed(spark, 4000)).withColumn("pv", (F.col("event_id") % 9).cast("double"))
    framed = add_lags(materialize(df, "test"), ["pv"], [5], block_rows=64, keep_block="_block").na.drop()
    ranked = framed.withColumn("_r", F.row_number().over(Window.partitionBy("series_id", "_block").orderBy("time_idx")))
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = index_blocks(framed, "_block").select("series_id", "ts", "event_id", "time_idx")
    assert got.exceptAll(_plain_index(framed.select("series_id", "ts", "event_id"))).count() == 0
    assert got.count() == framed.count()
