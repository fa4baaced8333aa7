"""Joins whose strategy follows from a measured size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio_spark.session import materialize

BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
SALTS = 64


def table_size(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes (of their JSON, which no column type hides); one aggregate."""
    size = F.octet_length(F.to_json(F.struct("*")))
    return df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """An error if a key is null or repeats."""
    null = " OR ".join(f"`{k}` IS NULL" for k in keys)
    twice = df.groupBy(*[F.col(f"`{k}`") for k in keys]).count().where(f"count > 1 OR {null}").limit(3).collect()
    if twice:
        raise ValueError(f"{what} must have one row for each {', '.join(keys)}; not so: {[tuple(r)[:-1] for r in twice]}")


def attach(
    df: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Column | None = None,
    broadcast_rows: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join a narrow parameter table (per series, per slice) onto the rows.

    ``small`` is stored once and measured. Up to ``broadcast_rows`` rows and
    ``BROADCAST_BYTES`` bytes it is broadcast, so the rows do not move. Beyond that it is a shuffle join; with
    ``spread`` (any column that varies within a key) each key is cut into
    ``salts`` parts so that one hot key does not land in one task.
    """
    on = list(on)
    small = materialize(small, "keyed")
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    rows, size = table_size(small)
    if rows <= limit and size <= BROADCAST_BYTES:
        return df.join(F.broadcast(small), on, how)
    if spread is None:
        return df.join(small, on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    part = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    return df.withColumn("_salt", part).join(salted, [*on, "_salt"], how).drop("_salt")
