"""Forecasts that are aligned where they are made: blocks that keep rows of one time together."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helio_spark.catalog import QUERIES, blends, inputs
from helio_spark.operators.forecasts import PART, PLACES, align_forecasts, made_by, stack_models
from helio_spark.operators.ordering import index_rows
from helio_spark.operators.row_frames import with_row_frames


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Runs of 1 to 700 events of one time in two series, some of no time."""
    folder = tmp_path_factory.mktemp("tied")
    rng = np.random.default_rng(4)
    start, rows = dt.datetime(2024, 1, 1), []
    for name in ("click", "view"):
        at = [None] * 5
        for i, n in enumerate([1, 2, 30, 1, 1, 700, 1, 90, 350, 3, 200, 1, 1, 1, 60, 260, 5]):
            at += [start + dt.timedelta(minutes=i)] * n
        rows += [(len(rows) + i, t, i % 7, name, float(v)) for i, (t, v) in enumerate(zip(at, rng.integers(0, 90, len(at))))]
    names = ["event_id", "ts", "user_id", "event_type", "value"]
    pq.write_table(pa.table({n: list(c) for n, c in zip(names, zip(*rows))}), f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("size", [7, 40, 256])
def test_frames_over_blocks_of_ties_equal_plain_windows(spark, tied, size):
    rows = inputs.raw(spark, tied).select("series_id", "time_idx", "ts", "pv")
    build = lambda w: {"back": F.sum("pv").over(w.rowsBetween(-6, 0)), "fwd": F.collect_list("pv").over(w.rowsBetween(1, 4))}
    made = with_row_frames(rows, build, back=6, fwd=4, block_rows=size, ties="ts", keep_block="block").persist()
    plain = rows.select("*", *[c.alias(n) for n, c in build(Window.partitionBy("series_id").orderBy("time_idx")).items()])
    key = lambda df: sorted(map(tuple, df.select(*plain.columns).collect()), key=lambda r: r[:2])
    assert key(made) == key(plain)
    # a block holds whole times, and there are several
    assert made.groupBy("series_id", "ts").agg(F.countDistinct("block").alias("n")).where("n > 1").count() == 0
    assert made.select("series_id", "block").distinct().count() > 4


def test_parts_give_the_same_forecasts(spark, tied):
    tables = inputs.model_tables(spark, tied)
    bare = {m: t.drop(PART).orderBy("series_id", "time_idx", "horizon_h") for m, t in tables.items()}
    for complete in (True, False):
        got = align_forecasts(stack_models(tables), inputs.MODELS, complete)
        want = align_forecasts(stack_models(bare), inputs.MODELS, complete)
        assert got.columns == want.columns
        assert got.drop("y_true").exceptAll(want.drop("y_true")).count() == 0 == want.drop("y_true").exceptAll(got.drop("y_true")).count()
    keys = ["series_id", "time_idx", "horizon_h"]
    stacked = stack_models({m: tables[m] for m in ("day", "week")}, PLACES)
    got, want = made_by(stacked, "week", keys), stacked.join(tables["week"].select(*keys), keys, "left_semi").select(*stacked.columns)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and got.count() < stacked.count()


def test_a_key_with_a_null_is_made_by_none(spark):
    rows = spark.createDataFrame(
        [(None, 1, "a"), (None, 1, "b"), (2, 1, "a"), (2, 1, "b"), (3, 1, "a")], "time_idx long, horizon_h int, model string"
    )
    assert sorted(tuple(r) for r in made_by(rows, "b", ["time_idx", "horizon_h"]).collect()) == [(2, 1, "a"), (2, 1, "b")]


def _exchanges(df) -> list[str]:
    """How the rows of each exchange are dealt, leaving out broadcasts and the single row of an aggregate."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\), (\w+)", plan)


def test_forecasts_are_aligned_without_a_shuffle(spark, tied):
    """Only events are shuffled; before, each forecast of each model was stored and then shuffled."""
    stacked = stack_models(inputs.model_tables(spark, tied))
    for complete in (True, False):
        assert {kind for _, kind in _exchanges(align_forecasts(stacked, inputs.MODELS, complete))} == {"REPARTITION_BY_NUM"}


def test_nothing_of_the_forecasts_is_stored(spark, tied, monkeypatch):
    labels = []
    for module in (inputs, blends):
        if hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", lambda df, label: labels.append(label) or df)
    QUERIES["weight_grid"](spark, tied)
    assert labels == []


def test_stacked_blend_is_made_without_a_shuffle(spark, tied):
    made = QUERIES["blend_stacked"](spark, tied)
    assert {kind for _, kind in _exchanges(made)} == {"REPARTITION_BY_NUM"}
    assert made.count() > 0


def test_index_is_in_the_order_of_time(spark, tied):
    rows = index_rows(inputs.events(spark, tied), ties=("event_id",))
    before = F.lag("ts").over(Window.partitionBy("series_id").orderBy("time_idx"))
    assert rows.withColumn("b", before).where("b > ts OR b IS NOT NULL AND ts IS NULL").count() == 0
