"""Measured series joined with the last known weather (backward as-of)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helio_spark.functions.weather import standardize_names
from helio_spark.operators.clean import alignable_columns
from helio_spark.operators.joins import attach
from helio_spark.operators.ordering import IDX, SERIES, TS, index_cells, range_slices


def align(
    measured: DataFrame,
    weather: DataFrame,
    target: str = "pv",
    keep_future: bool = False,
    series: str = SERIES,
    ts: str = TS,
    slices: int | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Each measured row with, per weather column, its last non-NULL value so far.

    Rows without a measured value are dropped; ``keep_future`` keeps them, for
    scoring with weather forecasts. The result carries a dense ``time_idx``.

    The result has one row for each (series, ts), whatever copies the inputs hold. Of
    measured copies the first with a value counts. Of weather copies the first applies at their
    time, and all of them fill later times. "First" is by ``order``, columns that either input may have
    (such as part_no, row_no; null where it has none), then by the measured value.

    Both inputs are laid out together in even slices of (series, ts); equal times lie in one
    slice, so copies are found between neighbours. The fill runs inside a slice; what a
    slice inherits is the last value of the slices before it, computed on one row per
    series and slice.
    """
    cols = [c for c in alignable_columns(weather) if c not in (series, ts, target, *order)]
    ties = [f"_order{i}" for i in range(len(order))]

    def ranked(df: DataFrame) -> list[Column]:
        return [F.col(c).alias(t) for c, t in zip(order, ties) if c in df.columns]

    value = F.col(target).cast("double")
    rows = measured.select(
        series, ts, value.alias(target), F.lit(1).alias("_kind"), value.isNull().alias("_empty"), *ranked(measured)
    ).unionByName(
        weather.select(series, ts, *cols, F.lit(0).alias("_kind"), F.lit(False).alias("_empty"), *ranked(weather)), allowMissingColumns=True
    )
    for t in ties:
        if t not in rows.columns:
            raise ValueError(f"neither input has the column {order[ties.index(t)]}")
    # at equal times the weather rows come first
    laid = range_slices(rows, series, (ts,), ties=("_kind", "_empty", *ties, target), slices=slices)
    laid = laid.drop("_empty", *ties)
    by_pos = Window.partitionBy(series, "_slice").orderBy("_pos")

    def like_last(w, kind: Column) -> Column:
        return F.coalesce((F.lag(ts).over(w) == F.col(ts)) & (F.lag("_kind").over(w) == kind), F.lit(False))

    # further weather rows of a time come after its measured row: they fill later times only
    copy = like_last(by_pos, F.col("_kind"))
    flagged = laid.withColumn("_copy", copy).withColumn("_place", F.when(F.col("_copy") & (F.col("_kind") == 0), 2).otherwise(F.col("_kind")))
    in_slice = Window.partitionBy(series, "_slice").orderBy(ts, "_place", "_pos")
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = flagged.select(
        series,
        ts,
        target,
        "_kind",
        "_copy",
        "_slice",
        "_pos",
        *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in cols],
        *([F.lead(F.struct(F.col(ts).alias("t"), F.col("_place").alias("p"))).over(in_slice).alias("_next")] if keep_future else []),
    ).where(~F.col("_copy"))
    if keep_future:
        twin_follows = (F.col("_kind") == 0) & F.coalesce((F.col("_next.t") == F.col(ts)) & (F.col("_next.p") == 1), F.lit(False))
        kept = filled.where(~twin_follows).drop("_next", "_copy")
    else:
        kept = filled.where(F.col(target).isNotNull()).drop("_copy")

    # the copies of a time keep their order, so the last value of a slice is the last by position
    last_in_slice = laid.groupBy(series, "_slice").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(c) for c in cols]
    )
    earlier = (
        Window.partitionBy(series).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    inherited = last_in_slice.select(
        series,
        "_slice",
        *[F.last(c, ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in cols],
    )
    # numbered before the join, so that counting the rows does not read it
    numbered = index_cells(kept, F.col("_slice"), series, ("_pos",))
    carried = [F.coalesce(c, f"_in_{c}").alias(c) for c in cols]
    return attach(numbered, inherited, [series, "_slice"], "left").select(
        series, ts, target, *carried, IDX
    )


def join_future_weather(history: DataFrame, future: DataFrame) -> DataFrame:
    """History and forecast weather as one table, under canonical names."""
    return standardize_names(history).unionByName(
        standardize_names(future), allowMissingColumns=True
    )
