"""Row features on a stream.

Only the operators that look at a single row are
meaningful on an unbounded table; they are the same expressions as in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from helio_spark.plans.features import add_row_features


def stream_row_features(stream: DataFrame, lat: float, lon: float, **options) -> DataFrame:
    """``add_row_features`` for a streaming DataFrame; coordinates must be given,
    since deriving them from the rows would need the whole stream."""
    return add_row_features(stream, lat=lat, lon=lon, **options)
