"""Hard negatives by exact integer scores, behind intervals from angles to reference directions.

Every vector is stored with its norm and its angles to a few reference directions.
By the triangle inequality the angle between two vectors lies between the greatest
difference and the least sum of their angles to a reference; times the norms this
bounds their score from both sides. Bounds are widened by more than their rounding,
and a pair is scored, in integers, only if its interval meets a window in which
a score could still change the result.

Anchors are taken in blocks of a fixed size, each compared with all rows where they
lie: tasks keep the best rows of each anchor only, and those are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helio_spark.session import materialize

#: Reference directions: sums of the vectors of one label class (label modulo this) each.
REFERENCES = 16
#: Anchors of one block (on the driver and in each task), and rows compared at a time.
BLOCK, ROWS = 4096, 1024
#: More than the error of an angle (arc cosine near 1 loses half the digits) and of a bound.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
NONE = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame, scale: float, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v): rows that take part, with components floor(scale * x)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros."""
    n, at = len(column), column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    out = np.zeros((n, width))
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(at[0], at[-1]) - at[:-1][row]] = values[at[0] : at[-1]]
    return out


def references(rows: DataFrame, width: int) -> np.ndarray:
    """Unit vectors (REFERENCES x width) along the sums of label classes; empty classes give zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((REFERENCES, width))
        for batch in batches:
            np.add.at(total, batch.column(0).to_numpy() % REFERENCES, _matrix(batch.column(1), width))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "value"])

    sums = rows.select("label", "v").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(REFERENCES * width)
    for at, value in sums.collect():  # REFERENCES x width numbers
        out[at] = value
    out = out.reshape(REFERENCES, width)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)


def angles_to(unit: np.ndarray, vectors: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ unit.T / np.where(norm > 0, norm, 1.0)[:, None], -1.0, 1.0))


def with_angles(rows: DataFrame, unit: np.ndarray) -> DataFrame:
    """(id, label, v, norm, angles)."""
    width = unit.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), width)
            norm = np.linalg.norm(v, axis=1)
            angles = angles_to(unit, v, norm)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norm), pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), len(unit)).cast(pa.list_(pa.float64()))],
                ["id", "label", "v", "norm", "angles"],
            )

    return rows.mapInArrow(run, "id long, label long, v array<double>, norm double, angles array<double>")


class Vectors:
    """Some rows as arrays."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.id, self.label, self.norm = (batch.column(i).to_numpy() for i in (0, 1, 3))
        self.v = _matrix(batch.column(2), width)
        self.angles = _matrix(batch.column(4), REFERENCES)

    def at(self, which) -> Vectors:
        out = object.__new__(Vectors)
        out.id, out.label, out.norm, out.v, out.angles = (x[which] for x in (self.id, self.label, self.norm, self.v, self.angles))
        return out


def score_bounds(a: Vectors, x: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each row of ``a`` with each of ``x``."""
    low = np.zeros((len(a.id), len(x.id)))
    high = np.full_like(low, np.pi)
    for r in range(REFERENCES):
        p, q = a.angles[:, r, None], x.angles[None, :, r]
        np.maximum(low, np.abs(p - q), out=low)
        total = p + q
        np.minimum(high, np.minimum(total, 2 * np.pi - total, out=total), out=high)
    size = a.norm[:, None] * x.norm[None, :]
    slack = size * SCORE_SLACK + 1.0
    most = size * np.cos(np.maximum(low - ANGLE_SLACK, 0.0)) + slack
    least = size * np.cos(np.minimum(high + ANGLE_SLACK, np.pi)) - slack
    return least, most


def integer_scores(a: Vectors, x: Vectors, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of x, score) of the marked pairs; exact, or an error beyond 64 bits.

    Partial sums are at most the product of the norms: below 2^53 doubles hold them.
    """
    i, j = np.nonzero(pairs)
    if not len(i):
        return i, j, np.zeros(0, np.int64)
    most = a.norm.max() * x.norm.max()
    if most >= 2.0**62:
        raise ValueError("scores pass 64 bits; use a smaller scale")
    exact = np.float64 if most < 2.0**52 else np.int64
    if len(i) * 20 > pairs.size:
        return i, j, (a.v.astype(exact) @ x.v.T.astype(exact))[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[s] = np.einsum("ij,ij->i", a.v[i[s]].astype(exact), x.v[j[s]].astype(exact)).astype(np.int64)
    return i, j, out


class Best:
    """The first ``k`` (score descending, id ascending) of each of ``n`` lists."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), NONE, np.int64), np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """The score a row needs at least, for each list."""
        return self.score[:, -1]

    def add(self, where: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        ok = (score > self.score[where, -1]) | ((score == self.score[where, -1]) & (ids < self.id[where, -1]))
        where, score, ids = where[ok], score[ok], ids[ok]
        if not len(where):
            return
        lists = np.unique(where)
        row = np.concatenate([np.repeat(lists, self.k), where])
        score = np.concatenate([self.score[lists].ravel(), score])
        ids = np.concatenate([self.id[lists].ravel(), ids])
        order = np.lexsort((ids, ~score, row))  # ~score descends without overflow
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, lists)
        take = first[:, None] + np.arange(self.k)
        self.score[lists], self.id[lists] = score[take], ids[take]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists, at = np.nonzero(self.score != NONE)
        return lists, self.score[lists, at], self.id[lists, at]


def _scan(stored: DataFrame, width: int, n: int, k: int, step, at_once: int) -> DataFrame:
    """(list, score, id): the first ``k`` rows of each of ``n`` lists; ``step`` fills a task's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n, k)
        for batch in batches:
            rows = Vectors(batch, width)
            order = np.lexsort((rows.angles.min(axis=1), rows.angles.argmin(axis=1)))  # neighbours first meet
            for at in range(0, len(order), at_once):
                step(best, rows.at(order[at : at + at_once]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], ["list", "score", "id"])

    found = stored.mapInArrow(run, "list long, score long, id long")
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _positives(stored: DataFrame, anchors, width: int, k: int, at_once: int) -> DataFrame:
    def step(best: Best, rows: Vectors) -> None:
        block = anchors.value
        for label in np.unique(rows.label):
            own, x = np.flatnonzero(block.label == label), rows.at(rows.label == label)
            if not len(own):
                continue
            a = block.at(own)
            _, most = score_bounds(a, x)
            open_ = (most >= best.least()[own][:, None]) & (a.id[:, None] != x.id[None, :])
            i, j, score = integer_scores(a, x, open_)
            best.add(own[i], score, x.id[j])

    return _scan(stored, width, len(anchors.value.id), k, step, at_once)


def _negatives(stored: DataFrame, anchors, windows, width: int, k: int, at_once: int) -> DataFrame:
    def step(best: Best, rows: Vectors) -> None:
        block, (owner, low, high) = anchors.value, windows.value
        used = np.unique(owner)
        if not len(used):
            return
        a = block.at(used)
        least, most = score_bounds(a, rows)
        other = (a.label[:, None] != rows.label[None, :]) & (a.id[:, None] != rows.id[None, :])
        floor = np.maximum(low, best.least())
        turn = np.arange(len(owner)) - np.searchsorted(owner, owner)  # of an anchor's windows
        open_ = np.zeros_like(other)
        for t in range(turn.max() + 1):
            mine = np.flatnonzero(turn == t)
            at = np.searchsorted(used, owner[mine])
            open_[at] |= (most[at] >= floor[mine][:, None]) & (least[at] <= high[mine][:, None])
        i, j, score = integer_scores(a, rows, open_ & other)
        for t in range(turn.max() + 1):
            mine = np.full(len(used), -1)
            at = np.flatnonzero(turn == t)
            mine[np.searchsorted(used, owner[at])] = at
            w = mine[i]
            ok = (w >= 0) & (score >= low[w]) & (score <= high[w])
            best.add(w[ok], score[ok], rows.id[j[ok]])

    return _scan(stored, width, len(windows.value[0]), k, step, at_once)


def _blocks(anchors: DataFrame, width: int, size: int) -> Iterator[Vectors]:
    """The anchors, ``size`` at a time on the driver."""
    kinds = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.float64())), ("norm", pa.float64()), ("angles", pa.list_(pa.float64()))])
    held = []
    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield Vectors(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.types)], kinds.names), width)
            held = []
    if held:
        yield Vectors(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.types)], kinds.names), width)


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = BLOCK,
    rows_at_once: int = ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x), a row's score is its integer inner product
    with the anchor, higher first, ties by the smaller id. An anchor's positives are
    its first rows of its label; each one's negatives are the first rows of other
    labels with low * positive_score <= 100 * score <= high * positive_score. Fewer than asked
    for are all there are; a positive without negatives gives no row.

    ``is_anchor`` is a condition on the columns of ``vectors``. A row without id,
    label or vector, or with a null or non-finite component, takes no part. Rows that
    bear an anchor's id are not its partners; repeated rows are rows of their own, and of
    equal ones each may be a partner. Shorter vectors count as padded with
    zeros. Other columns may have any names. An empty table gives no rows.

    A row meets each block of anchors once, whatever its label or vector, so common
    labels and vectors do not gather anywhere.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale, id_col, label_col, vector_col)
    anchor_rows = integer_vectors(vectors.where(is_anchor), scale, id_col, label_col, vector_col)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    unit = references(rows, width)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(with_angles(rows, unit).repartition(shuffles, "id"), "angles")
    anchors = materialize(with_angles(anchor_rows, unit), "anchors")
    parts = []
    for own in _blocks(anchors, width, block):
        shared = spark.sparkContext.broadcast(own)
        found = sorted((r.list, r.rank, r.score, r.id) for r in _positives(stored, shared, width, positives, rows_at_once).collect())
        if not found:
            continue
        owner, turn, score, ids = (np.array(c, np.int64) for c in zip(*found))  # at most positives x block
        windows = spark.sparkContext.broadcast((owner, -(-low * score // 100), high * score // 100))
        best = _negatives(stored, shared, windows, width, negatives, rows_at_once)
        named = spark.createDataFrame(
            [(i, int(own.id[o]), int(p), int(s)) for i, (o, p, s) in enumerate(zip(owner, ids, score))],
            "list long, anchor_id long, positive_id long, positive_score long",
        )
        parts.append(materialize(
            best.join(F.broadcast(named), "list").select(
                "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score"),
            ), "negatives",
        ))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, parts)
