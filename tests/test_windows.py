"""Stored window blocks against windows built row by row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helio_spark.operators.framing import make_encoder_samples, make_windows
from helio_spark.operators.splits import split_rows
from helio_spark.sources.windows import read_windows, unroll_windows, window_blocks, write_windows


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    sizes = {"a": 1, "b": 29, "c": 30, "d": 200, "e": 331}
    value = lambda: None if rng.random() < 0.1 else rng.random()
    out = [(s, i, 3600 * i, value(), value(), value()) for s, n in sizes.items() for i in range(n)]
    rng.shuffle(out)
    df = spark.createDataFrame(out, "series_id string, time_idx long, s long, pv double, ghi double, `air.temp` double")
    return df.withColumn("ts", F.timestamp_seconds("s")).repartition(5).persist()


def plain(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("block_rows", [1, 40, 100, 4096])
def test_blocks_hold_the_same_windows(rows, block_rows):
    blocks = window_blocks(rows, ["pv", "ghi"], 24, 6, block_rows=block_rows)
    got = unroll_windows(blocks)
    want = make_windows(rows, ["pv", "ghi"], 24, 6)
    columns = ["series_id", "origin_ts", "time_idx", "x", "y"]
    assert got.count() == 1 + 171 + 302
    assert plain(got, columns) == plain(want, columns)
    size = max(block_rows, 30)
    assert blocks.agg(F.max(F.size("rows"))).first()[0] <= size + 24 - 1 + 6


def test_store_within_splits(spark, rows, tmp_path):
    split = split_rows(rows)
    write_windows(split, f"{tmp_path}/w", ["ghi", "pv"], 10, 4, ahead=["ghi", "air.temp"], keys=["series_id", "split"], block_rows=50)
    got = read_windows(spark, f"{tmp_path}/w")
    made = make_encoder_samples(split, ["ghi"], ["pv"], 10, 4)
    ours = got.select(
        "series_id", "split", "time_idx", F.col("x").alias("encoder"),
        F.transform("x_ahead", lambda r: F.struct(r["ghi"].alias("ghi"))).alias("decoder"), "y",
    )
    columns = ["series_id", "split", "time_idx", "encoder", "decoder", "y"]
    assert plain(ours, columns) == plain(made, columns)


def test_stored_size(spark, tmp_path):
    rng = random.Random(1)
    df = spark.createDataFrame([("s", i, rng.random(), rng.random()) for i in range(20_000)], "series_id string, time_idx long, pv double, ghi double")
    blocks = window_blocks(df.withColumn("ts", F.timestamp_seconds("time_idx")), ["pv", "ghi"], 168, 24)
    stored = blocks.agg(F.sum(F.size("rows"))).first()[0]
    assert stored < 1.2 * 20_000
    assert blocks.agg(F.sum("windows")).first()[0] == 20_000 - 168 - 24 + 1


def test_edges(rows):
    assert window_blocks(rows.limit(0), ["pv"], 24, 6).count() == 0
    assert window_blocks(rows.where("series_id = 'a'"), ["pv"], 24, 6).count() == 0
    with pytest.raises(ValueError):
        window_blocks(rows, [], 24, 6)
    with pytest.raises(ValueError, match="no windows"):
        unroll_windows(window_blocks(rows.limit(0), ["pv"], 24, 6))
    one = unroll_windows(window_blocks(rows, ["pv"], 1, 1))
    assert one.count() == 28 + 29 + 199 + 330
