"""Every registered query against DuckDB on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from helio_spark.catalog import QUERIES, SQL
from tests.compare import difference, duck

NO_SQL = {"gbt_horizons", "feature_importance", "next_day_forecast", "walk_forward_models", "trial_search"}


#: Lags or windows of a week need more rows than the smallest data have.
LONG = {
    "gbt_stump", "stump_importance", "stump_next_day", "stump_folds", "stump_trials", "encoder_samples", "encoder_store",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.fixture(scope="module")
def long_con():
    return duck("/root/testdata/sf0.01")


def test_only_model_fits_lack_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_query_equals_sql(spark, long_con, name):
    assert difference(QUERIES[name](spark, "/root/testdata/sf0.01"), long_con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(SQL) - LONG))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


def test_contract_registers_them():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    df = contract.entry(spark)
    assert "mase_model" in df.columns and df.count() > 0
