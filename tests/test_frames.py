from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helio_spark.catalog import QUERIES
from helio_spark.catalog.frames import _digests
from helio_spark.operators.framing import make_encoder_samples, make_fusion_windows, make_windows
from helio_spark.operators.history import (
    add_history,
    add_lags,
    add_rolling_means,
    add_rolling_vars,
    add_targets,
    lag_columns,
    mean_columns,
    target_columns,
    var_columns,
)
from helio_spark.operators.row_frames import row_blocks, with_row_frames
from helio_spark.operators.scaling import apply_scaler, fit_scaler, window_count
from helio_spark.operators.forecasts import fold_scales, naive_scale
from helio_spark.operators.splits import fold_segments, split_rows, split_windows, walk_forward

GAPS = [1.0, None, 3.0, 4.0, None, None, None, 8.0]


def _series(spark, values, name="a"):
    rows = [(name, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, time_idx long, pv double")


def _column(df, name):
    return [r[name] for r in df.orderBy("series_id", "time_idx").select(name).collect()]


def test_rolling_known_values(spark):
    df = _series(spark, GAPS)
    mean = _column(add_rolling_means(df, ["pv"], [6]), "pv_roll6h")
    assert mean == pytest.approx([None, None, None, 8 / 3, 8 / 3, 8 / 3, None, 5.0])
    var = _column(add_rolling_vars(df, ["pv"], [3]), "pv_var3h")
    assert var == pytest.approx([0, 0, 1, 0.25, 0.25, 0, None, 0])


def test_lag_known_values(spark):
    assert _column(add_lags(_series(spark, [5.0, 6.0, 7.0]), ["pv"], [1]), "pv_lag1") == [None, 5.0, 6.0]


def _random(spark, n=3000):
    i = F.col("id")
    return spark.range(n).select(
        F.when(i < n * 2 // 3, "hot").otherwise(F.concat(F.lit("s"), (i % 5).cast("string"))).alias("series_id"),
        i.alias("k"),
        F.when(i % 11 > 0, F.pmod(F.xxhash64(i), F.lit(1000)) / 7.0).alias("pv"),
    ).withColumn("time_idx", (F.row_number().over(Window.partitionBy("series_id").orderBy("k")) - 1).cast("long"))


@pytest.mark.parametrize("block_rows", [1, 40, 97, 512, None])
def test_blocks_equal_the_plain_window(spark, block_rows):
    df = _random(spark)

    def build(w):
        return (
            lag_columns(w, ["pv"], [1, 24, 37])
            | mean_columns(w, ["pv"], [3, 24])
            | var_columns(w, ["pv"], [6])
            | target_columns(w, 13)
        )

    w = Window.partitionBy("series_id").orderBy("time_idx")
    plain = df.select("*", *[c.alias(n) for n, c in build(w).items()])
    got = with_row_frames(df, build, back=37, fwd=13, block_rows=block_rows)
    rounded = lambda d: d.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in d.dtypes])
    assert rounded(got).exceptAll(rounded(plain)).count() == 0 and got.count() == df.count()


def test_all_history_shares_one_exchange_and_sort(spark):
    made = add_history(_stored(spark), ["pv"], ["pv"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    assert plan.count("Window [") == 1
    assert "Python" not in plan


def _stored(spark):
    from helio_spark.session import materialize

    return materialize(_random(spark).select("series_id", "time_idx", "pv"), "test")


def test_targets(spark):
    out = add_targets(_series(spark, [1.0, 2.0, 3.0]), 2)
    assert _column(out, "target_h1") == [2.0, 3.0, None]
    assert _column(out, "target_h2") == [3.0, None, None]


def test_windows_count_and_content(spark):
    values = [float(i) for i in range(50)]
    df = _series(spark, values).withColumn("ts", F.timestamp_seconds(F.col("time_idx") * 3600))
    made = make_windows(df, ["pv", "time_idx"], 10, 4).orderBy("time_idx").collect()
    assert len(made) == 50 - 10 - 4 + 1
    first = made[0]
    assert [r.pv for r in first.x] == values[:10] and first.y == values[10:14] and first.time_idx == 9
    fusion = make_fusion_windows(df, ["time_idx"], 10, 4).orderBy("time_idx").first()
    assert fusion.x_target == values[:10] and [r.time_idx for r in fusion.x_future] == [10, 11, 12, 13]


def test_window_with_missing_values_keeps_its_length(spark):
    df = _series(spark, GAPS).withColumn("ts", F.timestamp_seconds("time_idx"))
    made = make_windows(df, ["pv"], 3, 2).orderBy("time_idx").collect()
    assert len(made) == 4 and [r.pv for r in made[0].x] == [1.0, None, 3.0] and made[0].y == [4.0, None]


def test_encoder_samples_stay_in_their_split(spark):
    df = split_rows(_series(spark, [float(i) for i in range(100)]))
    made = make_encoder_samples(df, ["time_idx"], ["pv"], 10, 5).collect()
    sizes = {r.split: 0 for r in made}
    for r in made:
        sizes[r.split] += 1
    rows = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert sizes == {s: n - 14 for s, n in rows.items() if n > 14}


def test_split_bounds_are_computed_in_doubles(spark):
    # 0.7 + 0.1 = 0.7999999999999999
    df = spark.range(1001).select(F.lit("a").alias("series_id"), F.col("id").alias("time_idx"))
    sizes = {r.split: r["count"] for r in split_rows(df, 0.7, 0.1).groupBy("split").count().collect()}
    assert sizes == {"train": 701, "val": 99, "test": 201}
    n = 1000 + 168 + 24 - 1
    rows = spark.range(n).select(F.lit("a").alias("series_id"), F.col("id").alias("time_idx"))
    sizes = {r.split: r["count"] for r in split_windows(rows, 168, 24).groupBy("split").count().collect()}
    assert sizes == {"train": 700, "val": 100, "test": 200}


def test_purge_removes_origins_with_leaking_targets(spark):
    df = spark.range(100).select(F.lit("a").alias("series_id"), F.col("id").alias("time_idx"))
    out = {r.time_idx: r.split for r in split_rows(df, 0.6, 0.2, purge=5).collect()}
    train_end = max(i for i, s in out.items() if s == "train")
    val_start = min(i for i, s in out.items() if s == "val")
    assert val_start - train_end == 6 and sum(s == "purged" for s in out.values()) == 10


def test_walk_forward_bounds(spark):
    df = spark.range(200).select(F.lit("a").alias("series_id"), F.col("id").alias("time_idx"))
    got = walk_forward(df, 9).groupBy("fold", "role").agg(F.min("time_idx"), F.max("time_idx")).collect()
    want = set()
    for k in range(9):
        end = 100 + k * 20
        if end + 20 >= 200:
            break
        want |= {(k + 1, "train", 0, end - 1), (k + 1, "val", end, end + 19)}
    assert {tuple(r) for r in got} == want


def test_scaler_equals_flattened_windows(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(5e6, 3.0, 120)
    seq_len, horizon = 12, 4
    n_train = int((120 - seq_len - horizon + 1) * 0.7)
    flat = np.concatenate([values[i : i + seq_len] for i in range(n_train)])
    df = _series(spark, values.tolist()).withColumn("flat", F.lit(2.0))
    scaler = fit_scaler(df, ["pv", "flat"], seq_len, horizon)
    row = scaler.first()
    assert row.mean_pv == pytest.approx(flat.mean(), rel=1e-12)
    assert row.scale_pv == pytest.approx(flat.std(), rel=1e-9)
    assert row.scale_flat == 1.0
    scaled = _column(apply_scaler(df, scaler, ["pv"]), "pv")
    assert scaled == pytest.approx(((values - flat.mean()) / flat.std()).tolist(), rel=1e-6)
    counts = df.select(window_count(F.col("time_idx"), F.lit(n_train), seq_len).alias("n")).collect()
    brute = [sum(i <= j < i + seq_len for i in range(n_train)) for j in range(120)]
    assert [r.n for r in counts] == brute


def test_fold_segments_say_what_walk_forward_repeats(spark):
    sizes = {"a": 30, "b": 61, "c": 100, "d": 130, "e": 5, "f": 257}
    df = spark.createDataFrame([(s, i, float((i * i) % 7)) for s, n in sizes.items() for i in range(n)], "series_id string, time_idx long, pv double")
    for folds in (1, 3, 5, 9):
        repeated = walk_forward(df, folds)
        placed = fold_segments(df, folds)
        assert placed.count() == df.count()
        want = {(r.series_id, r.time_idx, r.fold, r.role) for r in repeated.collect()}
        got = set()
        for r in placed.where("segment is not null").collect():
            got |= {(r.series_id, r.time_idx, k, "train") for k in range(r.segment + 1, r.last_fold + 1)}
            if r.segment:
                got.add((r.series_id, r.time_idx, r.segment, "val"))
        assert got == want
        scales = {(r.series_id, r.fold): r.scale for r in fold_scales(placed, folds).collect()}
        slow = naive_scale(repeated.where("role = 'train'"), by=("series_id", "fold")).collect()
        assert scales.keys() == {(r.series_id, r.fold) for r in slow}
        assert all(scales[r.series_id, r.fold] == (None if r.scale is None else pytest.approx(r.scale)) for r in slow)


def test_windows_collect_a_block_once(spark):
    # a sliding frame would collect each row seq_len times
    df = _stored(spark).withColumn("ts", F.timestamp_seconds("time_idx"))
    split = df.withColumn("split", F.lit("all"))
    for made in (
        make_windows(df, ["pv"], 100, 7), make_fusion_windows(df, ["pv"], 100, 7), make_encoder_samples(split, ["pv"], ["time_idx"], 100, 7),
    ):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Window [" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_window_edges_by_loop(spark):
    # several blocks, an even block edge, series of exactly and just under one window, null series and values
    sizes = {"a": 9000, None: 4096, "b": 192, "c": 191}
    value = lambda s, i: None if i % 7 == 3 else float((i * i) % 1000)
    df = spark.createDataFrame([(s, i, value(s, i)) for s, n in sizes.items() for i in range(n)], "series_id string, time_idx long, pv double")
    df = df.withColumn("ts", F.timestamp_seconds("time_idx")).repartition(5)
    past = F.expr("transform(x, r -> r.pv)").alias("x")
    got = {(r.series_id, r.time_idx): (r.x, r.y) for r in make_windows(df, ["pv"], 168, 24).select("series_id", "time_idx", past, "y").collect()}
    assert len(got) == sum(max(0, n - 191) for n in sizes.values())
    for (s, i), (x, y) in got.items():
        assert x == [value(s, k) for k in range(i - 167, i + 1)] and y == [value(s, k) for k in range(i + 1, i + 25)]
    with pytest.raises(ValueError):
        make_windows(df, ["pv"], 0, 24)


def test_window_digests(spark):
    rows = [(1, [1.5, None, -0.25], [(2.0,), (None,)]), (2, [None], []), (3, [float("nan"), float("inf"), float("-inf"), 1e30, -1e30], [(0.0000006,)])]
    made = spark.createDataFrame(rows, "time_idx long, y array<float>, x array<struct<`v`:float>>").repartition(1)
    got = {r.time_idx: (r.a, r.b) for r in _digests(made, ["time_idx"], {"a": ("y", None), "b": ("x", "v")}).collect()}
    top, low = 2**63 - 1, -(2**63)
    want = {1: ("1500000,-250000", "2000000"), 2: ("", ""), 3: (f"0,{top},{low},{top},{low}", "1")}
    assert got == {k: tuple(hashlib.md5(t.encode()).hexdigest() for t in v) for k, v in want.items()}


def test_window_digests_are_not_interpreted(spark, tmp_path):
    # a lambda over each window's values took most of the time of these queries
    kind = F.when(F.col("id") % 3 > 0, "view").otherwise("click").alias("event_type")
    spark.range(3000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7).alias("user_id"), kind, F.sqrt("id").alias("value")
    ).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("windows", "fusion_windows", "encoder_samples", "window_store", "encoder_store"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "transform(" not in plan and "MapInArrow" in plan, name


def test_windows_by_column(spark):
    # a slice of structs writes each of them for every origin
    rows = [(s, i, None if i % 7 == 3 else float(i), float(i * i)) for s, n in (("a", 300), ("b", 9), ("c", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, time_idx long, pv double, temp double").withColumn("ts", F.timestamp_seconds("time_idx"))
    split = df.withColumn("split", F.when(F.col("time_idx") < 150, "train").otherwise("test"))
    makers = {
        "x": lambda **o: make_windows(df, ["pv", "temp"], 10, 4, **o),
        "x_future": lambda **o: make_fusion_windows(df, ["pv", "temp"], 10, 4, **o),
        "encoder": lambda **o: make_encoder_samples(split, ["pv"], ["temp"], 10, 4, **o),
    }
    for branch, make in makers.items():
        field = lambda c: F.col(branch)[c]
        columns = ["series_id", "time_idx", field("pv").alias("p"), field("temp").alias("t"), "y"]
        plain, flat = make(), make(by_column=True)
        assert flat.schema[branch].dataType.simpleString() == "struct<pv:array<float>,temp:array<float>>"
        want = sorted(map(str, plain.select(*columns).collect()))
        assert len(want) > 200 and sorted(map(str, flat.select(*columns).collect())) == want


def test_block_copies_are_not_interpreted(spark):
    df = _series(spark, [float(i) for i in range(90)])
    for back, fwd in ((5, 3), (5, 0), (0, 3), (20, 20)):
        made = row_blocks(df, back, fwd, block_rows=20)
        assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r.time_idx, r._block, r._shift) for r in made.collect())
        want = [(i, i // 20 + s, s) for i in range(90) for s in (0, 1, -1) if s == 0 or (s == 1 and i % 20 >= 20 - back) or (s == -1 and i % 20 < fwd)]
        assert got == sorted(want)
