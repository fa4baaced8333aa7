"""Chronological splits and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio_spark.operators.joins import attach
from helio_spark.operators.ordering import IDX, SERIES

TRAIN, VAL, TEST, PURGED = "train", "val", "test", "purged"


def share(n: Column, ratio: float) -> Column:
    """``int(n * ratio)`` in the same double arithmetic as Python."""
    return F.floor(n * F.lit(ratio)).cast("long")


def series_length(df: DataFrame, series: str = SERIES, idx: str = IDX) -> DataFrame:
    return df.groupBy(series).agg((F.max(idx) + 1).alias("_rows"))


def with_length(
    df: DataFrame, series: str = SERIES, idx: str = IDX, lengths: DataFrame | None = None
) -> DataFrame:
    """``_rows``: the length of the row's series, from ``lengths`` if given."""
    known = series_length(df, series, idx) if lengths is None else lengths
    return attach(df, known, [series], "inner", spread=F.col(idx))


def split_rows(
    df: DataFrame,
    train: float = 0.6,
    val: float = 0.2,
    purge: int = 0,
    series: str = SERIES,
    idx: str = IDX,
) -> DataFrame:
    """``split`` by inclusive cut-offs on ``time_idx``.

    With ``purge=H`` the last H train and val origins, whose targets lie in the
    next split, are labelled ``purged``.
    """
    last = F.col("_rows") - 1
    cut_train, cut_val = share(last, train), share(last, train + val)
    i = F.col(idx)
    label = F.when(i <= cut_train, TRAIN).when(i <= cut_val, VAL).otherwise(TEST)
    if purge:
        leaks = ((i <= cut_train) & (i > cut_train - purge)) | (
            (i > cut_train) & (i <= cut_val) & (i > cut_val - purge)
        )
        label = F.when(leaks, PURGED).otherwise(label)
    return with_length(df, series, idx).withColumn("split", label).drop("_rows")


def split_windows(
    df: DataFrame,
    seq_len: int,
    horizon: int,
    train: float = 0.7,
    val: float = 0.1,
    series: str = SERIES,
    idx: str = IDX,
) -> DataFrame:
    """Rows that are window origins, with ``window_no`` and ``split`` by count.

    Works on the narrow row table: origin ``i`` closes window ``i - seq_len + 1``,
    so no window has to be built to be assigned.
    """
    windows = F.col("_rows") - seq_len - horizon + 1
    n_train, n_val = share(windows, train), share(windows, val)
    no = F.col("window_no")
    return (
        with_length(df, series, idx)
        .withColumn("window_no", F.col(idx) - (seq_len - 1))
        .where((no >= 0) & (no < windows))
        .withColumn(
            "split", F.when(no < n_train, TRAIN).when(no < n_train + n_val, VAL).otherwise(TEST)
        )
        .drop("_rows")
    )


def head_share(df: DataFrame, ratio: float, series: str = SERIES, idx: str = IDX) -> DataFrame:
    """The first ``int(n * ratio)`` rows of each series."""
    return (
        with_length(df, series, idx).where(F.col(idx) < share(F.col("_rows"), ratio)).drop("_rows")
    )


def fold_segments(
    df: DataFrame,
    folds: int,
    val_frac: float = 0.1,
    start_frac: float = 0.5,
    min_start: int = 24,
    lengths: DataFrame | None = None,
    series: str = SERIES,
    idx: str = IDX,
) -> DataFrame:
    """Each row once, with ``segment`` and its series' ``last_fold``; arithmetic on ``time_idx``.

    Fold k trains on segments below k and validates on segment k (see ``walk_forward``);
    ``last_fold`` is the last whose block does not reach the end of the series. Rows in
    no fold have no segment. What folds need of their train rows is a running sum over segments.
    """
    n, i = F.col("_rows"), F.col(idx)
    val_len = F.greatest(F.lit(1), share(n, val_frac))
    start = F.greatest(F.lit(min_start), share(n, start_frac))
    last = F.least(F.lit(folds).cast("long"), F.floor((n - 1 - start) / val_len))
    segment = F.when(i < start, F.lit(0).cast("long")).otherwise(F.floor((i - start) / val_len) + 1)
    return (
        with_length(df, series, idx, lengths)
        .withColumns({"segment": segment.cast("int"), "last_fold": F.greatest(last, F.lit(0)).cast("int")})
        .withColumn("segment", F.when(F.col("segment") <= F.col("last_fold"), F.col("segment")))
        .drop("_rows")
    )


def walk_forward(
    df: DataFrame,
    folds: int,
    val_frac: float = 0.1,
    start_frac: float = 0.5,
    min_start: int = 24,
    lengths: DataFrame | None = None,
    series: str = SERIES,
    idx: str = IDX,
) -> DataFrame:
    """Each row once per fold it belongs to, with ``fold`` (from 1) and ``role``.

    Folds expand: fold k trains on all rows before its validation block. Folds
    whose block would reach the end of the series are left out. ``lengths`` (see
    ``series_length``) serves tables that do not hold every row of a series.
    """
    n = F.col("_rows")
    val_len = F.greatest(F.lit(1), share(n, val_frac))
    start = F.greatest(F.lit(min_start), share(n, start_frac))
    train_end = start + (F.col("fold") - 1) * val_len
    val_end = train_end + val_len
    return (
        with_length(df, series, idx, lengths)
        .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
        .where((val_end < n) & (F.col(idx) < val_end))
        .withColumn("role", F.when(F.col(idx) < train_end, TRAIN).otherwise(VAL))
        .drop("_rows")
    )
