"""Forecasts of series that have several events at one time."""

from __future__ import annotations

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from helio_spark.catalog import QUERIES, SQL
from tests.compare import difference


@pytest.fixture(scope="module")
def twice(tmp_path_factory):
    """Each time holds two events of its series, with other values."""
    folder = tmp_path_factory.mktemp("twice")
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=i // 4), i % 7, ("click", "view")[i % 2], float(i * 37 % 101)) for i in range(600)]
    names = ["event_id", "ts", "user_id", "event_type", "value"]
    pq.write_table(pa.table({n: list(c) for n, c in zip(names, zip(*rows))}), f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["blend_stacked", "weight_store"])
def test_origins_of_one_time_stay_apart(spark, twice, name):
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM read_parquet('{twice}/events.parquet')")
    assert difference(QUERIES[name](spark, twice), con, SQL[name]) is None
