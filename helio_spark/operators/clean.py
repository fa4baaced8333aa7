"""Row and column cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helio_spark.functions.weather import is_weather_text, numeric_columns
from helio_spark.operators.ordering import SERIES, TS, reindex

# fixed values: a column whose name holds one of these must not be missing
CRITICAL_WORDS = ("pv", "ghi", "dni", "dhi", "lag", "roll", "var")


#: Types whose values an aggregate can replace in place; with others Spark sorts the rows first.
_IN_PLACE = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.DateType, T.TimestampType, T.TimestampNTZType,
)
#: Bits of the last column of an order of two that is packed into one number.
ROW_BITS = 40


def _in_place(df: DataFrame, cols: Sequence[str]) -> bool:
    return all(isinstance(df.schema[c].dataType, _IN_PLACE) for c in cols)


def packed_order(df: DataFrame, order: Sequence[str]) -> Column:
    """One value that orders rows as ``order`` does: the column itself, two whole numbers as one, or a struct.

    Two whole numbers (such as file and row) are packed if neither is negative, the second is under
    2 ** 40 and the first under 2 ** 22; others fail the job rather than being ordered wrongly.
    """
    whole = all(isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) for c in order)
    if len(order) == 1:
        return F.col(f"`{order[0]}`")
    if len(order) != 2 or not whole:
        return F.struct(*[F.col(f"`{c}`") for c in order])
    a, b = (F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)) for c in order)
    fits = (a >= 0) & (a < 1 << 62 - ROW_BITS) & (b >= 0) & (b < 1 << ROW_BITS)
    wrong = F.raise_error(F.lit(f"{order} do not fit into one number")).cast("long")
    return F.when(fits, F.shiftleft(a, ROW_BITS) + b).otherwise(wrong)


def row_by(df: DataFrame, keys: Sequence[str], order: Column, newest: bool = False) -> DataFrame:
    """One row per key: that with the least (or greatest) ``order``, null ones last.

    If all columns have a fixed width, each is kept in place in a hash aggregate, and rows are
    neither sorted nor copied before their key is met; all columns follow the same comparisons, so
    they come from one row. Otherwise the rows are structs, which a sort brings together.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    grouped = df.groupBy(*[F.col(f"`{c}`") for c in keys])
    if rest and _in_place(df, rest):
        return grouped.agg(*[pick(F.col(f"`{c}`"), order).alias(c) for c in rest]).select(*[F.col(f"`{c}`") for c in df.columns])
    row = pick(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_row")
    return grouped.agg(row).select(*[F.col(f"`{c}`") for c in keys], "_row.*").select(*[F.col(f"`{c}`") for c in df.columns])


def dedupe_first(
    df: DataFrame, keys: Sequence[str] = (SERIES, TS), order: Sequence[str] = ("part_no", "row_no")
) -> DataFrame:
    """One row per key, the first by ``order``.

    An aggregate rather than a ranking window: copies are dropped before the
    shuffle, so a key with any number of copies moves one row per task.
    """
    return row_by(df, keys, packed_order(df, order))


def keep_measured(df: DataFrame, target: str = "pv", keep_future: bool = False) -> DataFrame:
    return df if keep_future else df.where(F.col(target).isNotNull())


def alignable_columns(df: DataFrame) -> list[str]:
    """Numeric columns and the weather text."""
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c in numeric or is_weather_text(c)]


def critical_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if any(word in c for word in CRITICAL_WORDS)]


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value in ``cols`` (default: the critical columns)."""
    return df.na.drop(subset=list(critical_columns(df.columns) if cols is None else cols))


def feature_columns(df: DataFrame, skip: Sequence[str] = (SERIES,)) -> list[str]:
    """Numeric columns that hold any value, without targets and ``skip``.

    One aggregate over the candidates; only its single row reaches the driver.
    """
    candidates = [
        c for c in numeric_columns(df) if not c.startswith("target_h") and c not in skip
    ]
    if not candidates:
        return []
    seen = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in candidates]).first()
    return [c for c in candidates if seen[c]]


def drop_incomplete_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    targets = [c for c in df.columns if c.startswith("target_h")]
    return df.na.drop(subset=[*features, *targets])


def conform(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (SERIES, TS)) -> DataFrame:
    """Exactly the model's features, in its order; absent ones are NULL."""
    have = set(df.columns)
    return df.select(
        *keep,
        *[
            (F.col(c) if c in have else F.lit(None).cast("double")).alias(c)
            for c in features
            if c not in keep
        ],
    )


def keep_daylight(df: DataFrame, zenith: str = "sp_zenith", max_zenith: float = 90.0) -> DataFrame:
    """Rows whose zenith is unknown or at most ``max_zenith``."""
    return df.where(F.col(zenith).isNull() | (F.col(zenith) <= max_zenith))


def drop_and_reindex(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop incomplete rows, then close the gaps in ``time_idx``."""
    return reindex(drop_incomplete(df, cols))
