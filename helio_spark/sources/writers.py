"""Writers of processed tables, forecasts, metrics and weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio_spark.operators.ordering import IDX, SERIES

# text formats drop microseconds unless told otherwise
TEXT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
FILE_BLOCKS = 1 << 20  # rows of one series that share a writing task


def write_processed(df: DataFrame, path: str, by: Sequence[str] = (SERIES,)) -> None:
    """Parquet in folders ``by`` series; reads of one site prune to its folder.

    Rows are sent to writers by series and million-row block, so a series gives
    few files and a long series many writers. With very many small series pass
    ``by=()``: the sorted files then prune by their statistics.
    """
    if IDX in df.columns:
        df = df.repartition(SERIES, F.floor(F.col(IDX) / FILE_BLOCKS)).sortWithinPartitions(SERIES, IDX)
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_forecasts(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A row for each origin and horizon. Text is compressed: it repeats its keys in every row."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt in ("csv", "json"):
        writer = writer.option("timestampFormat", TEXT_TIME).option("compression", "gzip")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric, history and configuration tables, one JSON object per line."""
    df.write.mode("overwrite").json(path, timestampFormat=TEXT_TIME)


def write_weights(spark: SparkSession, weights: Mapping[str, float], path: str) -> None:
    row = [(list(weights), [float(w) for w in weights.values()])]
    table = spark.createDataFrame(row, "model_names array<string>, weights array<double>")
    table.coalesce(1).write.mode("overwrite").json(path)
