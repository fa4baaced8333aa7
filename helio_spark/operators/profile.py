"""Column profiles and value distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: shares of missing values that raise a finding
CRITICAL_SHARE = 0.5
WARNING_SHARE = 0.1


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: type, missing rows and share, severity. One pass over the table."""
    cols = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in cols]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(t).alias("data_type"),
                (F.col("_n") - F.col(f"`{c}`")).alias("missing"),
            )
            for c, t in df.dtypes
        ]
    )
    missing_share = F.col("missing") / F.nullif(F.col("_n"), F.lit(0))
    severity = (
        F.when(missing_share > CRITICAL_SHARE, "critical")
        .when(missing_share > WARNING_SHARE, "warning")
        .otherwise("ok")
    )
    return counts.select("_n", F.inline(entries)).select(
        "column_name",
        "data_type",
        F.col("_n").alias("total"),
        "missing",
        missing_share.alias("missing_share"),
        severity.alias("severity"),
    )


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def range_statistics(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Row count, time range, and min / max / mean / missing of each column."""
    stats = [
        F.count(F.lit(1)).alias("n"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    ]
    for c in cols:
        stats += [
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
            F.avg(c).alias(f"{c}_mean"),
            (F.count(F.lit(1)) - F.count(c)).alias(f"{c}_missing"),
        ]
    return df.groupBy(*by).agg(*stats)
