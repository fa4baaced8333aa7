"""Queries with an SQL twin against DuckDB, and what is registered."""

from __future__ import annotations

import pytest

import corpus_pipeline
from helio_spark.llm.queries import QUERIES, SQL
from tests.compare import difference, duck


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), duck(sf_dir), SQL[name]) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
