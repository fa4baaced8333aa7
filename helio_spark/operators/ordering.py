"""Row positions within a series, without one task per series.

``time_idx`` is the dense 0-based position of a row in its series. A plain
``row_number().over(partitionBy(series))`` would sort a whole series in one
task; here the rows are counted and numbered in bounded cells and the cells are
chained by a running sum over the (small) table of cell counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helio_spark.operators.joins import attach
from helio_spark.session import materialize

SERIES = "series_id"
TS = "ts"
IDX = "time_idx"
CELL_ROWS = 16_384


def _before(count: str, series: str, cell: str) -> Column:
    """Rows of the series in all earlier cells."""
    earlier = (
        Window.partitionBy(series).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum(count).over(earlier), F.lit(0))


def range_slices(
    df: DataFrame,
    series: str = SERIES,
    order: Sequence[str] = (TS,),
    ties: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Lay rows out in sorted slices of even size and store them.

    Adds ``_slice`` (ascending with ``series, order``) and ``_pos`` (0-based
    position in the slice). Slices follow the data's own distribution, so a
    series, day or hour that holds a third of all rows is spread over a third
    of the slices. Rows equal in ``series, order`` stay in one slice, sorted by
    ``ties``. The layout is stored because positions from sampled ranges
    would not be stable if the plan ran twice.
    """
    keys = [series, *order]
    ranged = (
        df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    )
    # monotonically_increasing_id = partition number << 33 | row number in it
    row_id = F.col("_row_id")
    laid = (
        ranged.sortWithinPartitions(*keys, *ties)
        .withColumn("_row_id", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright(row_id, 33))
        .withColumn("_pos", row_id.bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_row_id")
    )
    return materialize(laid, "slices")


def index_rows(
    df: DataFrame,
    series: str = SERIES,
    order: Sequence[str] = (TS,),
    ties: Sequence[str] = (),
    name: str = IDX,
    slices: int | None = None,
) -> DataFrame:
    """``time_idx`` for any series, however its timestamps are distributed."""
    # ties are range keys too, so even many rows at one time are spread out
    laid = range_slices(df, series, (*order, *ties), slices=slices)
    counts = laid.groupBy("_slice", series).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    offsets = counts.select(
        "_slice", series, (_before("_n", series, "_slice") - F.col("_first")).alias("_offset")
    )
    return (
        attach(laid, offsets, ["_slice", series], "inner")
        .withColumn(name, F.col("_pos") + F.col("_offset"))
        .drop("_slice", "_pos", "_offset")
    )


def index_cells(
    df: DataFrame,
    cell: Column,
    series: str = SERIES,
    order: Sequence[str] = (TS,),
    name: str = IDX,
) -> DataFrame:
    """``time_idx`` where ``cell`` already bounds the rows of a series.

    ``cell`` must ascend with ``order``: the day of an hourly series (24 rows),
    a stored slice, or a block of an older index. One exchange on
    ``(series, cell)``; the counts come from a second, two-column read.
    """
    rows = df.withColumn("_cell", cell)
    counts = rows.groupBy(series, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(series, "_cell", _before("_n", series, "_cell").alias("_offset"))
    in_cell = Window.partitionBy(series, "_cell").orderBy(*order)
    numbered = rows.withColumn("_rank", F.row_number().over(in_cell))
    return (
        numbered.join(offsets, [series, "_cell"])
        .withColumn(name, F.col("_rank") - 1 + F.col("_offset"))
        .drop("_cell", "_rank", "_offset")
    )


def index_hourly(df: DataFrame, series: str = SERIES, ts: str = TS, name: str = IDX) -> DataFrame:
    """``time_idx`` of a series with at most one row per hour; ``df`` is evaluated once."""
    return index_blocks(df.withColumns({"_day": F.to_date(ts), name: F.col(ts)}), "_day", series, name)


def reindex(df: DataFrame, old: str = IDX, series: str = SERIES, name: str = IDX) -> DataFrame:
    """Close the gaps that a filter left in an index; ``df`` is evaluated once."""
    kept = df.withColumnRenamed(old, name).withColumn("_cell", F.floor(F.col(name) / CELL_ROWS))
    return index_blocks(kept, "_cell", series, name)


def index_blocks(
    df: DataFrame, block: str, series: str = SERIES, idx: str = IDX
) -> DataFrame:
    """Renumber the rows of a series by ``idx``, which ascends with ``block``.

    Rows that a window has just grouped by ``(series, block)`` need no further
    exchange for their rank in the block. The rows are stored with it,
    so that wide rows are neither computed twice (for the counts) nor shuffled
    again: the counts are read from two stored columns.
    """
    in_block = Window.partitionBy(series, block).orderBy(idx)
    stored = materialize(df.withColumn("_rank", F.row_number().over(in_block)), "blocks")
    counts = stored.groupBy(series, block).agg(F.max("_rank").alias("_n"))
    offsets = counts.select(series, block, _before("_n", series, block).alias("_offset"))
    return (
        attach(stored, offsets, [series, block], "inner")
        .withColumn(idx, F.col("_rank") - 1 + F.col("_offset"))
        .drop(block, "_rank", "_offset")
    )
