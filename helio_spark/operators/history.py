"""Lag, lead and rolling columns.

The ``*_columns`` functions return named expressions for one window, so several
can share a single ``with_row_frames`` call; the ``add_*`` functions are that
call for one kind. All of them are row-based: lag 24 is 24 rows back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from helio_spark.operators.joins import attach
from helio_spark.operators.ordering import IDX, SERIES
from helio_spark.operators.row_frames import with_row_frames

# fixed values: default lags and rolling widths, in rows
DEFAULT_LAGS = (1, 24, 48, 72, 96, 168)
DEFAULT_ROLLS = (3, 6, 12, 24)


def lag_columns(w: WindowSpec, cols: Sequence[str], lags: Sequence[int]) -> dict[str, Column]:
    return {f"{c}_lag{n}": F.lag(c, n).over(w) for c in cols for n in lags}


def _enough(c: str, frame: WindowSpec, width: int) -> Column:
    """At least half of the frame (and one row) holds a value."""
    return F.count(c).over(frame) >= max(1, width // 2)


def mean_columns(
    w: WindowSpec, cols: Sequence[str], widths: Sequence[int], unit: str = "h"
) -> dict[str, Column]:
    out = {}
    for c in cols:
        for n in widths:
            frame = w.rowsBetween(1 - n, 0)
            out[f"{c}_roll{n}{unit}"] = F.when(_enough(c, frame, n), F.avg(c).over(frame))
    return out


def var_columns(w: WindowSpec, cols: Sequence[str], widths: Sequence[int]) -> dict[str, Column]:
    """Population variance."""
    out = {}
    for c in cols:
        for n in widths:
            frame = w.rowsBetween(1 - n, 0)
            out[f"{c}_var{n}h"] = F.when(_enough(c, frame, n), F.var_pop(c).over(frame))
    return out


def target_columns(w: WindowSpec, horizon: int, target: str = "pv") -> dict[str, Column]:
    return {f"target_h{h}": F.lead(target, h).over(w) for h in range(1, horizon + 1)}


def future_columns(w: WindowSpec, cols: Sequence[str], horizon: int) -> dict[str, Column]:
    """Covariates ahead of the origin; on past data this is perfect foresight."""
    return {f"{c}_fut_h{h}": F.lead(c, h).over(w) for c in cols for h in range(1, horizon + 1)}


def add_lags(
    df: DataFrame, cols: Sequence[str], lags: Sequence[int] = DEFAULT_LAGS, **kw
) -> DataFrame:
    return with_row_frames(df, lambda w: lag_columns(w, cols, lags), back=max(lags), **kw)


def add_rolling_means(
    df: DataFrame, cols: Sequence[str], widths: Sequence[int] = DEFAULT_ROLLS, unit: str = "h", **kw
) -> DataFrame:
    return with_row_frames(
        df, lambda w: mean_columns(w, cols, widths, unit), back=max(widths), **kw
    )


def add_rolling_vars(
    df: DataFrame, cols: Sequence[str], widths: Sequence[int] = DEFAULT_ROLLS, **kw
) -> DataFrame:
    return with_row_frames(df, lambda w: var_columns(w, cols, widths), back=max(widths), **kw)


def add_history(
    df: DataFrame,
    lag_cols: Sequence[str],
    roll_cols: Sequence[str],
    lags: Sequence[int] = DEFAULT_LAGS,
    widths: Sequence[int] = DEFAULT_ROLLS,
    **kw,
) -> DataFrame:
    """Lags, rolling means and rolling variances in one window stage."""

    def build(w: WindowSpec) -> Mapping[str, Column]:
        return (
            lag_columns(w, lag_cols, lags)
            | mean_columns(w, roll_cols, widths)
            | var_columns(w, roll_cols, widths)
        )

    return with_row_frames(df, build, back=max([0, *lags, *widths]), **kw)


def add_targets(
    df: DataFrame,
    horizon: int,
    future_cols: Sequence[str] = (),
    target: str = "pv",
    **kw,
) -> DataFrame:
    """``target_h{h}`` and, if asked, ``{c}_fut_h{h}`` for h = 1..horizon."""
    present = [c for c in future_cols if c in df.columns]
    return with_row_frames(
        df,
        lambda w: target_columns(w, horizon, target) | future_columns(w, present, horizon),
        fwd=horizon,
        **kw,
    )


def add_future_covariates(
    df: DataFrame, cols: Sequence[str], horizon: int, **kw
) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return with_row_frames(df, lambda w: future_columns(w, present, horizon), fwd=horizon, **kw)


def fill_future_covariates(
    df: DataFrame,
    cols: Sequence[str],
    horizon: int,
    series: str = SERIES,
    idx: str = IDX,
) -> DataFrame:
    """Missing ``{c}_fut_h{h}`` take the last known value of ``c`` in the series."""
    present = [c for c in cols if c in df.columns]
    last = df.groupBy(series).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(idx))).alias(f"_last_{c}")
            for c in present
        ]
    )
    filled = {
        f"{c}_fut_h{h}": F.coalesce(f"{c}_fut_h{h}", f"_last_{c}")
        for c in present
        for h in range(1, horizon + 1)
        if f"{c}_fut_h{h}" in df.columns
    }
    joined = attach(df, last, [series], "left", spread=F.col(idx))
    return joined.withColumns(filled).drop(*[f"_last_{c}" for c in present])
