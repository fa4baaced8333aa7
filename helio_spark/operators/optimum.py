"""Blend weights that minimise RMSE or MAE over the whole simplex, with a proof of how near they are.

RMSE is a quadratic form of the error products, which one aggregate gives: its minimum
is the point of least norm in the hull of the models, found exactly by adding and
dropping models (an active set). MAE is convex and piecewise linear: every aggregate
gives its value and a subgradient at a few points, which is a plane below it; the lowest point
above all planes is a small linear program, and bounds the minimum from below.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helio_spark.operators.blending import BLOCK, _gram, _pairs, _pred, error_products
from helio_spark.session import materialize

#: Where the next points lie between the best point and the lowest of the planes.
FRACTIONS = (1.0, 0.5, 0.25, 0.75)
MAX_GROUPS = 10_000


def least_norm(gram: np.ndarray) -> np.ndarray:
    """The w on the simplex with the least ``w' gram w``; ``gram`` is positive semidefinite."""
    k = len(gram)
    unit = max(float(np.abs(gram).max()), 1e-300)
    e = gram / unit
    w = np.zeros(k)
    w[int(np.argmin(np.diag(e)))] = 1.0
    for _ in range(200 * k):
        slope = e @ w
        j = int(np.argmin(slope))
        if slope[j] >= w @ slope - 1e-14:
            break
        support = np.flatnonzero((w > 0) | (np.arange(k) == j))
        while True:  # the best weights of the support, over its whole affine plane
            m = len(support)
            system = np.zeros((m + 1, m + 1))
            system[:m, :m], system[:m, m], system[m, :m] = e[np.ix_(support, support)], 1.0, 1.0
            best = np.linalg.lstsq(system, np.append(np.zeros(m), 1.0), rcond=None)[0][:m]
            if (best >= 0).all():
                w = np.zeros(k)
                w[support] = best / best.sum()
                break
            old = w[support]
            down = best < 0
            step = float(np.min(old[down] / (old[down] - best[down])))
            new = np.maximum(old + step * (best - old), 0.0)
            new[down & (new <= 1e-15)] = 0.0
            w = np.zeros(k)
            w[support] = new / new.sum()
            kept = support[w[support] > 0]
            if len(kept) == m:  # nothing left the support: rounding only
                break
            support = kept
    return w


def lowest_of_planes(planes: np.ndarray) -> tuple[np.ndarray, float]:
    """w on the simplex with the least greatest ``planes @ w``, and a bound that no w can go below.

    A matrix game: with all entries over 0 it is max sum(x), planes x <= 1, solved by
    pivots from x = 0. The bound is the lowest corner of the mixture of planes that the
    solution ends with, which holds however exact the pivots were.
    """
    spread = max(float(planes.max() - planes.min()), 1e-300)
    a = (planes - planes.min()) / spread + 1.0
    rows, cols = a.shape
    table = np.zeros((rows + 1, cols + rows + 1))
    table[:rows, :cols], table[:rows, cols : cols + rows], table[:rows, -1] = a, np.eye(rows), 1.0
    table[rows, :cols] = -1.0
    basis = np.arange(cols, cols + rows)
    for turn in range(40 * (rows + cols)):
        improving = np.flatnonzero(table[rows, :-1] < -1e-12)
        if not len(improving):
            break
        # the steepest column; after many pivots the first one, which cannot cycle
        c = int(improving[np.argmin(table[rows, improving])] if turn < 10 * (rows + cols) else improving[0])
        able = np.flatnonzero(table[:rows, c] > 1e-11)
        if not len(able):
            break
        ratio = table[able, -1] / table[able, c]
        ties = able[ratio <= ratio.min() * (1 + 1e-13)]
        r = int(ties[np.argmax(table[ties, c])] if turn < 10 * (rows + cols) else ties[np.argmin(basis[ties])])
        table[r] /= table[r, c]
        others = np.arange(rows + 1) != r
        table[others] -= np.outer(table[others, c], table[r])
        basis[r] = c
    x = np.zeros(cols + rows)
    x[basis] = table[:rows, -1]
    x = np.maximum(x[:cols], 0.0)
    mixture = np.maximum(table[rows, cols : cols + rows], 0.0)
    return x / x.sum(), float((mixture / mixture.sum() @ planes).min())


def _complete(aligned: DataFrame, models: Sequence[str], by: Sequence[str]) -> DataFrame:
    rows = aligned.select(*[F.col(f"`{c}`") for c in by], F.col("y_true").cast("double").alias("_y"), *[_pred(m).cast("double").alias(f"_p{i}") for i, m in enumerate(models)])
    return rows.na.drop(subset=["_y", *[f"_p{i}" for i in range(len(models))]])


def optimal_weights(
    aligned: DataFrame,
    models: Sequence[str],
    metric: str = "rmse",
    by: Sequence[str] = (),
    tolerance: float = 1e-7,
    steps: int = 40,
) -> DataFrame:
    """``by``, n, ``w_{model}``, the least score, and ``gap``: how much lower it could be at most.

    Rows that lack the truth or a model don't count. MAE steps until every gap is at
    most ``tolerance`` times the score, or ``steps`` scans; all ``by`` groups (at most ``MAX_GROUPS``)
    go on together. Of several optima one is given.
    """
    if metric not in ("rmse", "mae"):
        raise ValueError(f"metric {metric!r} is not supported, use rmse or mae")
    if not models:
        raise ValueError("no models to weigh")
    by, models = list(by), list(models)
    return (_optimal_rmse if metric == "rmse" else _optimal_mae)(aligned, models, by, tolerance, steps)


def _optimal_rmse(aligned: DataFrame, models: list[str], by: list[str], tolerance: float, steps: int) -> DataFrame:
    pairs, k = _pairs(models), len(models)
    complete = aligned.na.drop(subset=[f"`pred_{m}`" for m in models])
    gram = error_products(complete, models, by).where("n > 0")
    flat = gram.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("n"), F.array(*[F.col(f"`{_gram(a, b)}`") for a, b in pairs]).alias("_e")
    )
    place = [(models.index(a), models.index(b)) for a, b in pairs]
    width = len(by) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, values in zip(batch.column(width - 1).to_pylist(), batch.column(width).to_pylist()):
                e = np.zeros((k, k))
                for (i, j), v in zip(place, values):
                    e[i, j] = e[j, i] = v / n
                w = least_norm(e)
                mean = float(w @ e @ w)
                low = max(0.0, mean - 2 * max(0.0, mean - float((e @ w).min())))
                out.append((w.tolist(), mean, low))
            w, mean, low = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(w, pa.list_(pa.float64())), pa.array(mean, pa.float64()), pa.array(low, pa.float64())],
                [*batch.schema.names[:width], "_w", "_mean", "_low"],
            )

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields[:width]]
    found = flat.mapInArrow(run, ", ".join([*kinds, "_w array<double>", "_mean double", "_low double"]))
    rmse = F.sqrt(F.greatest(F.col("_mean"), F.lit(0.0)))
    return found.select(
        *[F.col(f"_by{i}").alias(c) for i, c in enumerate(by)], "n", *[F.col("_w")[i].alias(f"w_{m}") for i, m in enumerate(models)],
        rmse.alias("rmse"), (rmse - F.sqrt("_low")).alias("gap"),
    )


def _planes(rows: DataFrame, by: list[str], groups: dict[tuple, np.ndarray], k: int) -> dict[tuple, tuple]:
    """{group: (n, values, subgradients)} at the points (rows of an array) of each group; one scan."""
    width = len(by)
    sent = rows.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        arrow: list[pa.DataType] = []
        for batch in batches:
            arrow = [c.type for c in batch.columns[:width]]
            y = batch.column(width).to_numpy()
            p = np.stack([c.to_numpy() for c in batch.columns[width + 1 :]], axis=1)
            code = np.zeros(len(y), np.int64)
            for column in batch.columns[:width]:
                encoded = column.dictionary_encode(null_encoding="encode")
                code = code * len(encoded.dictionary) + encoded.indices.to_numpy()
            _, first, group = np.unique(code, return_index=True, return_inverse=True)
            for g, at in enumerate(first):
                key = tuple(c[int(at)].as_py() for c in batch.columns[:width])
                if key not in sent.value:
                    continue
                points, mine = sent.value[key], np.flatnonzero(group == g)
                sums = held.setdefault(key, [0, np.zeros((len(points), k + 1))])
                sums[0] += len(mine)
                for a in range(0, len(mine), BLOCK):
                    block = mine[a : a + BLOCK]
                    error = y[block, None] - p[block] @ points.T
                    sums[1][:, 0] += np.abs(error).sum(axis=0)
                    sums[1][:, 1:] -= np.sign(error).T @ p[block]
        if not held:
            return
        keys = [pa.array([key[i] for key in held], t) for i, t in enumerate(arrow)]
        yield pa.RecordBatch.from_arrays(
            [*keys, pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1].ravel() for v in held.values()], pa.list_(pa.float64()))],
            [*names, "n", "sums"],
        )

    names = [f"_by{i}" for i in range(width)]
    flat = rows.select(*[F.col(c).alias(x) for c, x in zip(by, names)], "_y", *[f"_p{i}" for i in range(k)])
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields[:width]]
    sums = (
        flat.mapInArrow(run, ", ".join([*kinds, "n long", "sums array<double>"]))
        .select(*names, "n", F.posexplode("sums").alias("at", "s"))
        .groupBy(*names, "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    )
    out: dict[tuple, tuple] = {}
    for r in sums.collect():  # a few numbers for each group and point
        key = tuple(r[:width])
        n, values = out.setdefault(key, (r.n, np.zeros(groups[key].size // k * (k + 1))))
        values[r["at"]] = r.s / r.n
    sent.destroy()
    return {key: (n, v.reshape(-1, k + 1)[:, 0], v.reshape(-1, k + 1)[:, 1:]) for key, (n, v) in out.items()}


def _optimal_mae(aligned: DataFrame, models: list[str], by: list[str], tolerance: float, steps: int) -> DataFrame:
    k = len(models)
    rows = materialize(_complete(aligned, models, by), "errors")
    found = rows.select(*by).distinct().limit(MAX_GROUPS + 1).collect() if by else [()] * (0 if rows.isEmpty() else 1)
    if len(found) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of weights")
    start = np.vstack([np.eye(k), np.full((1, k), 1.0 / k)])
    asked = {tuple(r): start for r in found}
    cuts = {key: np.zeros((0, k)) for key in asked}
    best: dict[tuple, tuple] = {}
    for _ in range(steps):
        if not asked:
            break
        seen, again = _planes(rows, by, asked, k), {}
        for key, (n, values, slopes) in seen.items():
            points = asked[key]
            j = int(np.argmin(values))
            if key not in best or values[j] < best[key][1]:
                best[key] = (n, float(values[j]), points[j])
            base = values - (slopes * points).sum(axis=1)
            cuts[key] = np.vstack([cuts[key], base[:, None] + slopes])
            low_w, low = lowest_of_planes(cuts[key])
            gap = max(0.0, float(best[key][1] - low))
            best[key] = (*best[key][:3], gap)
            if gap > tolerance * best[key][1]:
                again[key] = np.stack([best[key][2] + f * (low_w - best[key][2]) for f in FRACTIONS])
        asked = again
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n long", *[f"`w_{m}` double" for m in models], "mae double", "gap double"])
    table = [(*key, n, *map(float, w), score, gap) for key, (n, score, w, gap) in best.items()]
    return aligned.sparkSession.createDataFrame(table, schema)
