"""Supervised samples: sliding windows and newest origins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helio_spark.operators.clean import row_by
from helio_spark.operators.ordering import IDX, SERIES, TS
from helio_spark.operators.row_frames import row_blocks


def _floats(cols: Sequence[str]) -> Column:
    """A row's values as a struct of floats; a struct keeps NULLs."""
    return F.struct(*[F.col(c).cast("float").alias(c) for c in cols])


def _field_names(blocks: DataFrame, value: str) -> list[str]:
    """Names of the fields of a collected value; none if it is no struct."""
    kind = blocks.schema["_rows"].dataType.elementType[value].dataType
    return kind.names if isinstance(kind, T.StructType) else []


def _sliced(
    df: DataFrame,
    values: Mapping[str, Column],
    branches: Mapping[str, tuple[str, bool]],
    seq_len: int,
    horizon: int,
    keys: Sequence[str],
    idx: str,
    ts: str | None = None,
    by_column: bool = False,
) -> DataFrame:
    """``keys``, origin_ts (with ``ts``), ``idx`` and ``branches`` of every origin that has all its rows.

    A branch names a column of ``values`` and whether it takes the ``horizon`` rows ahead or the
    ``seq_len`` rows up to the origin. A block's rows are collected and sorted once, and each
    origin takes its slices of them: a sliding frame would collect every row ``seq_len`` times.
    ``by_column`` slices each field of a struct on its own: flat arrays of floats are copied whole,
    where a slice of structs writes every one of them for every origin.
    """
    if seq_len < 1 or horizon < 1:
        raise ValueError("seq_len and horizon must be at least 1")
    head = {"_i": F.col(idx), "_s": F.col("_shift")} | ({"_ts": F.col(ts)} if ts else {})
    row = F.struct(*[c.alias(n) for n, c in (head | dict(values)).items()])
    blocks = row_blocks(df, seq_len, horizon, idx).groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(row)).alias("_rows")
    )
    fields = {n: _field_names(blocks, n) if by_column else [] for n in values}
    flat = {n: F.col("_rows")[n] for n in (*head, *[v for v in values if not fields[v]])}
    flat |= {f"{n}_{k}": F.col("_rows")[n][c] for n, names in fields.items() for k, c in enumerate(names)}
    arrays = blocks.select(*keys, *[c.alias(n) for n, c in flat.items()])
    origins = arrays.select(
        *keys, *[n for n in flat if n not in head], F.size("_i").alias("_n"), F.posexplode(F.arrays_zip(*head)).alias("_p", "_o")
    ).where((F.col("_o._s") == 0) & (F.col("_p") >= seq_len - 1) & (F.col("_p") + horizon < F.col("_n")))

    def cut(rows: str, ahead: bool) -> Column:
        return F.slice(rows, F.col("_p") + 2, horizon) if ahead else F.slice(rows, F.col("_p") - (seq_len - 2), seq_len)

    made = [
        F.struct(*[cut(f"{rows}_{k}", ahead).alias(c) for k, c in enumerate(fields[rows])]) if fields[rows] else cut(rows, ahead)
        for rows, ahead in branches.values()
    ]
    at = [F.col("_o._ts").alias("origin_ts")] if ts else []
    return origins.select(*keys, *at, F.col("_o._i").alias(idx), *[c.alias(n) for n, c in zip(branches, made)])


def make_windows(
    df: DataFrame,
    features: Sequence[str],
    seq_len: int,
    horizon: int,
    target: str = "pv",
    series: str | Sequence[str] = SERIES,
    ts: str = TS,
    idx: str = IDX,
    by_column: bool = False,
) -> DataFrame:
    """One row per origin: ``x`` = last ``seq_len`` rows, ``y`` = next ``horizon`` targets.

    ``x`` is an array of structs, or with ``by_column`` a struct of arrays, which costs a fraction.
    Multiplies the data by ``seq_len``; make it the last step before an export.
    """
    keys = [series] if isinstance(series, str) else list(series)
    values = {"_x": _floats(features), "_y": F.col(target).cast("float")}
    return _sliced(df, values, {"x": ("_x", False), "y": ("_y", True)}, seq_len, horizon, keys, idx, ts, by_column)


def make_fusion_windows(
    df: DataFrame,
    weather: Sequence[str],
    seq_len: int,
    horizon: int,
    target: str = "pv",
    series: str = SERIES,
    ts: str = TS,
    idx: str = IDX,
    by_column: bool = False,
) -> DataFrame:
    """Three branches per origin: target history, weather history, weather ahead; ``by_column`` as in ``make_windows``."""
    values = {"_x": _floats(weather), "_y": F.col(target).cast("float")}
    branches = {"x_target": ("_y", False), "x_weather": ("_x", False), "x_future": ("_x", True), "y": ("_y", True)}
    return _sliced(df, values, branches, seq_len, horizon, [series], idx, ts, by_column)


def make_encoder_samples(
    df: DataFrame,
    known: Sequence[str],
    unknown: Sequence[str],
    seq_len: int,
    horizon: int,
    target: str = "pv",
    split: str = "split",
    series: str = SERIES,
    idx: str = IDX,
    by_column: bool = False,
) -> DataFrame:
    """Encoder rows (known and unknown columns) and decoder rows (known only).

    Samples stay inside their split: its first ``seq_len - 1`` rows are context. ``by_column`` as in ``make_windows``.
    """
    past = list(dict.fromkeys([*known, *unknown, target]))
    values = {"_x": _floats(past), "_known": _floats(known), "_y": F.col(target).cast("float")}
    branches = {"encoder": ("_x", False), "decoder": ("_known", True), "y": ("_y", True)}
    return _sliced(df, values, branches, seq_len, horizon, [series, split], idx, by_column=by_column)


def latest_origin(
    df: DataFrame, target: str = "pv", series: str = SERIES, ts: str = TS
) -> DataFrame:
    """The newest measured row of each series.

    ``max_by`` keeps one row per series and task before the shuffle. Positions ascend with
    time, so they order the rows where there are any: of rows of one instant the later counts.
    """
    order = F.col(IDX) if IDX in df.columns else F.col(ts)
    return row_by(df.where(F.col(target).isNotNull()), [series], order, newest=True)


def first_per_horizon(
    df: DataFrame,
    keys: Sequence[str] = (SERIES, "horizon_h"),
    order: str = IDX,
) -> DataFrame:
    """Per column, the first non-NULL value by ``order`` within each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    )
