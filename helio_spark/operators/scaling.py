"""Standard scaling fitted on train windows, and per-series target scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio_spark.operators.joins import attach
from helio_spark.operators.ordering import IDX, SERIES
from helio_spark.operators.splits import share, with_length


def window_count(i: Column, n_train: Column, seq_len: int) -> Column:
    """In how many of the first ``n_train`` windows row ``i`` occurs.

    Lets the fit run on rows instead of overlapping windows (``seq_len`` times
    the data).
    """
    first = F.greatest(F.lit(0), i - (seq_len - 1))
    last = F.least(i, n_train - 1)
    return F.greatest(F.lit(0), last - first + 1)


def fit_scaler(
    df: DataFrame,
    cols: Sequence[str],
    seq_len: int,
    horizon: int,
    train: float = 0.7,
    series: str = SERIES,
    idx: str = IDX,
) -> DataFrame:
    """One row: ``mean_{c}``, ``scale_{c}`` over the train windows of all series.

    Population deviation; a constant column gets scale 1. Two passes (mean, then
    squared deviations) so that large values do not cancel.
    """
    windows = F.col("_rows") - seq_len - horizon + 1
    times = window_count(F.col(idx), share(windows, train), seq_len)
    counted = with_length(df.select(series, idx, *cols), series, idx).withColumn("_times", times)
    counted = counted.where(F.col("_times") > 0)
    def mean(c: str, value: Column) -> Column:
        rows = F.sum(F.when(F.col(c).isNotNull(), F.col("_times")))
        return F.sum(value * F.col("_times")) / rows

    centers = counted.agg(*[mean(c, F.col(c)).alias(c) for c in cols]).first()
    out = []
    for c in cols:
        center = F.lit(centers[c]).cast("double")
        var = mean(c, F.pow(F.col(c) - center, F.lit(2)))
        out.append(F.first(center).alias(f"mean_{c}"))
        out.append(F.when(var > 0, F.sqrt(var)).otherwise(F.lit(1.0)).alias(f"scale_{c}"))
    return counted.agg(*out)


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(value - mean) / scale with the one row of a fitted scaler, as constants."""
    fitted = scaler.first()
    return df.withColumns(
        {
            c: (F.col(c) - F.lit(fitted[f"mean_{c}"])) / F.lit(fitted[f"scale_{c}"])
            for c in cols
        }
    )


def scale_target(
    df: DataFrame,
    target: str = "pv",
    where: Column | None = None,
    series: str = SERIES,
    idx: str = IDX,
) -> DataFrame:
    """``{target}_scaled`` by each series' own mean and sample deviation."""
    value = F.col(target) if where is None else F.when(where, F.col(target))
    stats = df.groupBy(series).agg(
        F.avg(value).alias("center"), F.stddev_samp(value).alias("spread")
    )
    joined = attach(df, stats, [series], "left", spread=F.col(idx))
    scaled = (F.col(target) - F.col("center")) / F.nullif(F.col("spread"), F.lit(0.0))
    return joined.withColumn(f"{target}_scaled", scaled)
