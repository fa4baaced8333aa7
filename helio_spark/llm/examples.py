"""Labelled examples for the classifiers: a bounded sample that does not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio_spark.session import materialize


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def sampled(rows: DataFrame, key: Column, bound: int, by: str | None = None) -> DataFrame:
    """About ``bound`` rows at most (four deviations are left free), the same ones on each run.

    With ``by``, each of its values gets an equal part. Every row is kept or not by
    the hash of its key against the share wanted, so there is no sort.
    """
    sizes = {r[0]: r[1] for r in (rows.groupBy(by) if by else rows.groupBy(F.lit(0).alias("_all"))).count().collect()}
    part = bound / max(len(sizes), 1)
    room = max(part - 4 * part**0.5, 1.0)
    unit = F.xxhash64(key, F.lit("examples")).cast("double") / 2.0**64 + 0.5
    if by is None:
        return rows.where(unit < room / max(sum(sizes.values()), 1))
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col(by) == value, F.lit(room / n)).otherwise(share)
    return rows.where(unit < share)


def labelled_examples(
    docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, bound: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Stored (id, text, label) of about ``bound`` labelled rows for which ``learn`` holds.

    The sampled ids are bounded, so they are broadcast to the documents. Rows
    without an id or a label are no examples.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label")
    )
    few = sampled(known, F.col("_id"), bound)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return materialize(rows.join(F.broadcast(few), F.col("id") == F.col("_id")).select("id", "text", "label"), "examples")
