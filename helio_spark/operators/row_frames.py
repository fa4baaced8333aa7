"""Window functions over row positions, cut into fixed-size blocks.

Lags, leads and rolling frames reach a known number of rows back and forward.
Rows are grouped into blocks of ``time_idx``; the rows near a block's edge are
copied into the neighbouring block, so every frame is complete inside its block
and no task holds more than one block of a series. All frames of one call share
one exchange and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from helio_spark.operators.joins import attach
from helio_spark.operators.ordering import IDX, SERIES
from helio_spark.session import materialize

# A window task keeps this many rows of a block in memory
# (spark.sql.windowExec.buffer.in.memory.threshold); longer blocks go through a
# spillable sorter, which each frame then reads on its own.
BUFFER_ROWS = 4_096
#: Rows of a task where blocks stay together for further steps without an exchange.
TASK_ROWS = 8_192


def row_blocks(
    df: DataFrame, back: int, fwd: int, idx: str = IDX, block_rows: int | None = None
) -> DataFrame:
    """Rows with their ``_block``, and copies for the blocks that reach them; those have a ``_shift`` of 1 or -1."""
    size = max(block_rows or BUFFER_ROWS - back - fwd, back, fwd)
    place = F.col(idx) % size
    late = place >= size - back if back else F.lit(False)
    early = place < fwd if fwd else F.lit(False)
    # constant arrays: one made for each row would be cleared of nulls by an interpreted lambda
    shifts = lambda *s: F.array(*map(F.lit, s))
    copies = F.when(late & early, shifts(0, 1, -1)).when(late, shifts(0, 1)).when(early, shifts(0, -1)).otherwise(shifts(0))
    shift = F.explode(copies) if back or fwd else F.lit(0)
    return df.withColumn("_shift", shift).withColumn(
        "_block", F.floor(F.col(idx) / size) + F.col("_shift")
    )


def tie_blocks(
    df: DataFrame, back: int, fwd: int, ties: str, series: str = SERIES, idx: str = IDX, block_rows: int | None = None
) -> DataFrame:
    """``row_blocks`` with a block that is a function of (series, ``ties``): rows equal in both share one.

    ``ties`` must ascend with ``idx``, nulls first. A block is numbered by the place of its first row, and
    takes all rows that tie with its last one. Blocks are dealt over tasks of about ``TASK_ROWS`` rows by
    (series, block), so what follows by these keys needs no exchange.
    """
    # half a buffer, to leave room for ties
    size = max(block_rows or BUFFER_ROWS // 2 - back - fwd, back, fwd)
    base = lambda place: F.floor(place / size)
    cells = df.groupBy(series, base(F.col(idx)).alias("_cell")).agg(
        F.min(F.struct(F.col(ties).alias("at"), (-F.col(idx)).alias("end"))).alias("_first"), F.max(ties).alias("_last")
    )
    # a table of few rows: how far the ties of the cell before reach into a cell, and the block that they are of
    order = Window.partitionBy(series).orderBy("_cell")
    cells = cells.withColumns({"_left": F.lag("_last").over(order), "_some": F.lag("_cell").over(order).isNotNull()})
    own = F.when(~(F.col("_some") & F.col("_last").eqNullSafe(F.col("_left"))), F.col("_cell"))
    cells = cells.withColumns({
        "_upto": F.when(F.col("_some") & F.col("_first.at").eqNullSafe(F.col("_left")), -F.col("_first.end")),
        "_of": F.max(own).over(order.rowsBetween(Window.unboundedPreceding, -1)),
    })
    for name, there in (("_p", F.lag), ("_n", F.lead)):
        cells = cells.withColumns({f"{name}{c}": there(c).over(order) for c in ("_upto", "_of")})
    cells = materialize(cells.drop("_first", "_last", "_left", "_some"), "cells")
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(cells.count() * size / TASK_ROWS))
    rows = attach(df.withColumn("_cell", base(F.col(idx))), cells, [series, "_cell"])

    def block(place: Column) -> Column:
        cell = base(place)
        upto, of = (
            F.when(cell == F.col("_cell"), F.col(c)).when(cell < F.col("_cell"), F.col(f"_p{c}")).otherwise(F.col(f"_n{c}"))
            for c in ("_upto", "_of")
        )
        return F.when(place <= upto, of).otherwise(cell)

    rows = rows.withColumn("_own", block(F.col(idx)))
    reach = F.sequence(block(F.greatest(F.col(idx) - fwd, F.lit(0))), block(F.col(idx) + back))
    rows = rows.withColumn("_block", F.explode(reach)).withColumn("_shift", F.col("_block") - F.col("_own"))
    return rows.select(*df.columns, "_shift", "_block").repartition(tasks, series, "_block")


def with_row_frames(
    df: DataFrame,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    back: int = 0,
    fwd: int = 0,
    series: str | Sequence[str] = SERIES,
    idx: str = IDX,
    block_rows: int | None = None,
    keep_block: str | None = None,
    ties: str | None = None,
) -> DataFrame:
    """Add the columns of ``build(window)``; ``window`` is ordered by ``idx``.

    ``back`` / ``fwd`` are the furthest rows any expression reads. ``series`` may
    name several columns; ``idx`` must be dense within them. ``keep_block`` names a
    column for the block number, for a further window over the same blocks. With ``ties``
    blocks are those of ``tie_blocks``.
    """
    blocks = tie_blocks(df, back, fwd, ties, series, idx, block_rows) if ties else row_blocks(df, back, fwd, idx, block_rows)
    keys = [series] if isinstance(series, str) else list(series)
    window = Window.partitionBy(*keys, "_block").orderBy(idx)
    made = build(window)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    if keep_block:
        kept.append(F.col("_block").alias(keep_block))
    return (
        blocks.select(*kept, "_shift", *[c.alias(n) for n, c in made.items()])
        .where(F.col("_shift") == 0)
        .drop("_shift")
    )
