from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from helio_spark.operators.history import add_lags
from helio_spark.session import materialize, shared_dir, stored_scope
from helio_spark.sources.cache import cached_table


@pytest.fixture()
def built(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(40).select(F.lit("a").alias("series_id"), F.col("id").alias("time_idx"), F.rand(1).alias("pv")).write.parquet(source)
    calls = []

    def get(lags, fail=False):
        def build():
            calls.append(lags)
            if fail:
                raise RuntimeError("no table")
            return add_lags(spark.read.parquet(source), ["pv"], lags)

        return cached_table(spark, f"{tmp_path}/out", build, [source], {"lags": lags})

    return get, calls, source, f"{tmp_path}/out"


def test_table_is_built_once_per_options_and_inputs(spark, built):
    get, calls, source, out = built
    assert "pv_lag2" in get([1, 2]).columns and get([1, 2]).count() == 40
    assert calls == [[1, 2]]
    assert "pv_lag3" in get([1, 3]).columns and calls == [[1, 2], [1, 3]]
    assert get([1, 3]).count() == 40 and len(calls) == 2
    spark.range(40, 45).select(F.lit("a").alias("series_id"), F.col("id").alias("time_idx"), F.lit(0.5).alias("pv")).write.mode("append").parquet(source)
    assert get([1, 3]).count() == 45 and len(calls) == 3
    assert len([d for d in os.listdir(out) if d.startswith("data-")]) == 1  # tables that no manifest names are gone


def test_failed_build_leaves_the_old_table(built):
    get, calls, _, _ = built
    assert get([1]).count() == 40
    with pytest.raises(RuntimeError):
        get([2], fail=True)
    assert get([1]).count() == 40 and calls == [[1], [2]]


def test_closed_scope_leaves_no_file(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    outside = materialize(spark.range(5), "outside")
    kept = set(os.listdir(folder))
    with stored_scope(spark):
        table = materialize(spark.range(10), "inside")
        with stored_scope(spark):
            materialize(table, "inner")
            assert len(set(os.listdir(folder)) - kept) == 2
        assert table.count() == 10 and len(set(os.listdir(folder)) - kept) == 1
    assert set(os.listdir(folder)) == kept and len(kept - before) == 1
    with pytest.raises(ZeroDivisionError), stored_scope(spark):
        materialize(spark.range(10), "inside")
        1 / 0
    assert set(os.listdir(folder)) == kept and outside.count() == 5
