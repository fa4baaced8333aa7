"""Sliding windows stored as the rows they are made of.

Written out, a window of 168 rows holds every row 168 times. Here each block of a
series is stored once, with the rows that its windows need from the neighbouring blocks (a
halo of ``seq_len - 1 + horizon`` rows), and the range of its windows' origins. The
reader unrolls windows block by block. With blocks of 4,096 rows the halo of
168/24 adds five percent.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio_spark.operators.ordering import IDX, SERIES, TS

BLOCK_ROWS = 4_096
#: Windows that the reader unrolls at once.
AT_ONCE = 256


def window_blocks(
    df: DataFrame,
    past: Sequence[str],
    seq_len: int,
    horizon: int,
    ahead: Sequence[str] = (),
    target: str = "pv",
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    idx: str = IDX,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``keys``, block, ``first``, ``origin``, ``windows``, ``rows``: one row for each block that has windows.

    ``rows`` are the block's rows in order from position ``first`` on, as structs of
    time and single-precision values; its windows have the origins ``origin`` to ``origin + windows - 1``.
    ``idx`` must be dense within ``keys``. A window lies within one key: all its
    rows and the ``horizon`` rows ahead are there.
    """
    if seq_len < 1 or horizon < 1 or block_rows < 1:
        raise ValueError("seq_len, horizon and block_rows must be at least 1")
    if not past:
        raise ValueError("a window needs a past column")
    size = max(block_rows, seq_len + horizon)
    values = list(dict.fromkeys([*past, *ahead, target]))
    own, place = F.floor(F.col(idx) / size), F.col(idx) % size
    copies = F.array_compact(
        F.array(own, F.when(place >= size - seq_len + 1, own + 1), F.when((place < horizon) & (own > 0), own - 1))
    )
    row = F.struct(F.col(idx).cast("long").alias("_i"), F.col(ts).alias("_ts"), *[F.col(f"`{c}`").cast("float").alias(c) for c in values])
    blocks = (
        df.select(*keys, row.alias("_row"), F.explode(copies).alias("block"))
        .groupBy(*keys, "block").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    )
    first, last = F.element_at("_rows", 1)["_i"], F.element_at("_rows", -1)["_i"]
    origin = F.greatest(F.col("block") * size, first + (seq_len - 1))
    end = F.least((F.col("block") + 1) * size - 1, last - horizon)
    bare = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in ("_ts", *values)]))
    return blocks.select(
        *keys, "block", first.alias("first"), origin.alias("origin"), (end - origin + 1).cast("int").alias("windows"),
        F.lit(seq_len).alias("seq_len"), F.lit(horizon).alias("horizon"), F.array(*map(F.lit, past)).alias("past"),
        F.array(*map(F.lit, ahead)).cast("array<string>").alias("ahead"), F.lit(target).alias("target"), bare.alias("rows"),
    ).where("windows > 0")


def write_windows(df: DataFrame, path: str, *args, **options) -> None:
    """Store ``window_blocks`` as Parquet; a task writes whole blocks."""
    window_blocks(df, *args, **options).write.mode("overwrite").parquet(path)


def unroll_windows(blocks: DataFrame, idx: str = IDX) -> DataFrame:
    """``keys``, origin_ts, ``idx``, x, x_ahead, y of every window of ``window_blocks``.

    ``x``: the last ``seq_len`` rows up to the origin as structs of the past columns; ``x_ahead``: the
    next ``horizon`` rows with the columns known ahead (left out if there are none); ``y``: their targets.
    Null values stay null. Windows leave a task some hundred at a time.
    """
    head = blocks.select("past", "ahead", "target").first()
    keys = blocks.columns[: blocks.columns.index("block")]
    if head is None:
        raise ValueError("there are no windows")
    past, ahead, target = list(head["past"]), list(head["ahead"]), head["target"]
    struct = lambda names: "array<struct<" + ",".join(f"`{c}`:float" for c in names) + ">>"
    schema = [*[f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in keys], "origin_ts timestamp", f"`{idx}` long", f"x {struct(past)}"]
    if ahead:
        schema.append(f"x_ahead {struct(ahead)}")
    schema.append("y array<float>")

    def lists(column, at: np.ndarray) -> pa.Array:
        flat = column.take(pa.array(at.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32()), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                rows = block["rows"].values
                seq_len, horizon = block["seq_len"].as_py(), block["horizon"].as_py()
                first = block["origin"].as_py() - block["first"].as_py()
                part = lambda names: pa.StructArray.from_arrays([rows.field(c) for c in names], names)
                for a in range(0, block["windows"].as_py(), AT_ONCE):
                    at = first + np.arange(a, min(a + AT_ONCE, block["windows"].as_py()))
                    back, fore = at[:, None] + np.arange(1 - seq_len, 1), at[:, None] + np.arange(1, horizon + 1)
                    out = [pa.array([block[c].as_py()] * len(at), batch.schema.field(c).type) for c in keys]
                    out += [rows.field("_ts").take(pa.array(at)), pa.array(at + block["first"].as_py()), lists(part(past), back)]
                    out += [lists(part(ahead), fore)] if ahead else []
                    out.append(lists(rows.field(target), fore))
                    names = [*keys, "origin_ts", idx, "x", *(["x_ahead"] if ahead else []), "y"]
                    yield pa.RecordBatch.from_arrays(out, names)

    sent = blocks.select(*keys, "first", "origin", "windows", "seq_len", "horizon", "rows")
    return sent.mapInArrow(run, ", ".join(schema))


def read_windows(spark: SparkSession, path: str, idx: str = IDX) -> DataFrame:
    """The windows of a table that ``write_windows`` stored."""
    return unroll_windows(spark.read.parquet(path), idx)
