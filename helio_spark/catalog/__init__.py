"""Registered queries over the sample tables, each with its SQL twin."""

from helio_spark.catalog import (  # noqa: F401  (importing registers the queries)
    blends,
    boosted,
    cleaning,
    features,
    frames,
    models,
    scoring,
    stores,
)
from helio_spark.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
