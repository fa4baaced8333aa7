"""Time-series forecasting data work on Spark DataFrames.

Every table is keyed by ``(series_id, ts)``; ``ts`` is a UTC ``TIMESTAMP``.
Operators take and return DataFrames and compose with ``DataFrame.transform``.
"""

from helio_spark.session import use_utc

__all__ = ["use_utc"]
