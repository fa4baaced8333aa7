"""Blends of forecasts and the search for their weights.

RMSE of a blend needs no pass per weight vector: with weights that sum to 1 the
blend's error is the weighted sum of the models' errors, so its mean square is
``w' E w / n`` with ``E[i,j] = sum(e_i * e_j)``. One aggregate over the forecasts
gives E; every weight vector and model subset is then scored on that one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio_spark.operators.forecasts import PART

WEIGHT_TOLERANCE = 1e-6
MAX_MODELS = 1000
#: Rows of a block that meet all grid points, and sums that a task holds.
BLOCK, HELD = 1024, 4_000_000


def _pred(m: str) -> Column:
    return F.col(f"`pred_{m}`")


def _weight(m: str) -> Column:
    return F.col(f"`w_{m}`")


def check_weights(weights: Mapping[str, float]) -> None:
    total = sum(weights.values())
    if abs(total - 1) > WEIGHT_TOLERANCE:
        raise ValueError(f"weights sum to {total}, not 1")


def blend(aligned: DataFrame, weights: Mapping[str, float], name: str = "y_pred") -> DataFrame:
    """Weighted sum of ``pred_{model}``; every model of ``weights`` must be present."""
    check_weights(weights)
    absent = [m for m in weights if f"pred_{m}" not in aligned.columns]
    if absent:
        raise ValueError(f"no forecasts of {absent}")
    total = None
    for m, w in weights.items():
        part = _pred(m) * F.lit(float(w))
        total = part if total is None else total + part
    return aligned.withColumn(name, total)


def weight_table(weights: DataFrame) -> dict[str, float]:
    """A weight table (``model, weight``) as a mapping, by model name, checked.

    At most ``MAX_MODELS`` rows, one for each model, that sum to 1.
    """
    rows = weights.select("model", "weight").orderBy("model").limit(MAX_MODELS + 1).collect()
    table = {r.model: r.weight for r in rows}
    if len(rows) > MAX_MODELS or len(table) < len(rows) or None in table or None in table.values():
        raise ValueError(f"the weights need one row for each of at most {MAX_MODELS} models")
    check_weights(table)
    return table


def blend_stacked(
    stacked: DataFrame, weights: DataFrame, keys: Sequence[str], members: bool = False
) -> DataFrame:
    """Blend ``model, y_pred`` rows with a weight table (``model, weight``).

    A key that lacks a weighted model, or has one twice, fails the job; models
    without a weight are passed over. The truth is that of the first model by name
    that has one. ``members`` adds the forecast of each model as ``pred_{model}``. Rows with
    a ``PART`` are not shuffled for the aggregate.
    """
    part = [PART] if PART in stacked.columns else []
    table = weight_table(weights)
    made = {m: F.when(F.col("model") == m, F.col("y_pred")) for m in table}
    # a number, because a name as order would make the aggregate sort all rows
    rank = F.coalesce(*[F.when(F.col("model") == m, F.lit(i)) for i, m in enumerate(table)])
    total = F.lit(0.0)
    for m, w in table.items():
        total = total + _pred(m) * F.lit(float(w))
    wrong = F.raise_error(F.lit("a forecast lacks a weighted model, or has one twice")).cast("double")
    # aggregates of the whole key, so that one without any weighted model is seen
    rows = stacked.groupBy(*keys, *part).agg(
        F.min_by("y_true", F.when(F.col("y_true").isNotNull(), rank)).alias("y_true"),
        *[F.max(c).alias(f"pred_{m}") for m, c in made.items()],
        *[F.count(c).alias(f"_n_{m}") for m, c in made.items()],
    )
    once = reduce(lambda a, b: a & b, [F.col(f"`_n_{m}`") == 1 for m in table])
    rows = rows.withColumn("y_pred", F.when(once, total).otherwise(wrong)).drop(*part, *[f"_n_{m}" for m in table])
    return rows if members else rows.drop(*[f"pred_{m}" for m in table])


def _with_truth(rows: DataFrame) -> DataFrame:
    """A forecast without a truth has no error: it is neither summed nor counted."""
    return rows.where(F.col("y_true").isNotNull())


def _units(m: str) -> str:
    return f"_k_{m}"


def explode_weight_grid(
    df: DataFrame, models: Sequence[str], steps: int, member: Mapping[str, Column] | None = None
) -> DataFrame:
    """Repeat each row for every point of the weight simplex.

    Weights are multiples of ``1/(steps-1)`` that sum to 1, held as ``w_{model}``;
    ``member`` limits the models that may have weight. The last weight is what
    the others leave, so only valid points are made.
    """
    top = steps - 1
    left = F.lit(top)
    for m in models[:-1]:
        upper = left if member is None else F.when(member[m], left).otherwise(F.lit(0))
        df = df.withColumn(_units(m), F.explode(F.sequence(F.lit(0), upper)))
        left = left - F.col(f"`{_units(m)}`")
    df = df.withColumn(_units(models[-1]), left)
    if member is not None:
        df = df.where((F.col(f"`{_units(models[-1])}`") == 0) | member[models[-1]])
    weights = {f"w_{m}": F.col(f"`{_units(m)}`") / F.lit(float(top)) for m in models}
    return df.withColumns(weights).drop(*[_units(m) for m in models])


def explode_random_weights(
    df: DataFrame, models: Sequence[str], trials: int, seed: int = 42
) -> DataFrame:
    """Repeat each row for ``trials`` random weight vectors, by stick breaking.

    Each weight is a uniform share of what the earlier ones left. The uniform
    numbers come from a digest of (seed, trial, model), so they do not depend on
    partitions.
    """
    df = df.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    left = F.lit(1.0)
    for i, m in enumerate(models[:-1]):
        digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col("trial").cast("string"), F.lit(f"-{i}")))
        uniform = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
        df = df.withColumn(f"w_{m}", uniform * left)
        left = left - _weight(m)
    return df.withColumn(f"w_{models[-1]}", left)


def _pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(models) for b in models[i:]]


def _gram(a: str, b: str) -> str:
    return f"_e_{a}__{b}"


def error_products(
    aligned: DataFrame, models: Sequence[str], by: Sequence[str | Column] = ()
) -> DataFrame:
    """``n`` and the sums of error products of all model pairs, per ``by``."""
    err = {m: F.col("y_true") - _pred(m) for m in models}
    return _with_truth(aligned).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(err[a] * err[b]).alias(_gram(a, b)) for a, b in _pairs(models)],
    )


def _drop_products(df: DataFrame, models: Sequence[str]) -> DataFrame:
    return df.drop(*[_gram(a, b) for a, b in _pairs(models)])


def blend_rmse(models: Sequence[str]) -> Column:
    """RMSE of the blend ``w_{model}`` from error products."""
    total = F.lit(0.0)
    for a, b in _pairs(models):
        twice = 1.0 if a == b else 2.0
        # a pair with a zero weight adds nothing, even if never forecast together
        part = _weight(a) * _weight(b) * F.col(f"`{_gram(a, b)}`") * twice
        total = total + F.when((_weight(a) != 0) & (_weight(b) != 0), part).otherwise(0.0)
    return F.sqrt(F.greatest(total, F.lit(0.0)) / F.col("n"))


def score_weight_grid(
    aligned: DataFrame,
    models: Sequence[str],
    steps: int = 11,
    metric: str = "rmse",
    by: Sequence[str] = (),
) -> DataFrame:
    """Score of every point of the weight grid, per ``by``."""
    if metric == "rmse":
        gram = error_products(aligned, models, by)
        scored = explode_weight_grid(gram, models, steps).withColumn("rmse", blend_rmse(models))
        return _drop_products(scored, models)
    if metric == "mae":
        return _mean_abs_errors(aligned, models, simplex_points(len(models), steps), by).drop("_point")
    raise ValueError(f"metric {metric!r} is not supported, use rmse or mae")


def simplex_points(models: int, steps: int) -> np.ndarray:
    """The points of ``explode_weight_grid`` as rows, in its order."""
    top = steps - 1
    units = [()]
    for _ in range(models - 1):
        units = [(*u, k) for u in units for k in range(top - sum(u) + 1)]
    return np.array([(*u, top - sum(u)) for u in units], np.float64) / top


def _patterns(models: Sequence[str]) -> Column:
    """One bit for each model that made a forecast."""
    have = F.lit(0)
    for i, m in enumerate(models):
        have = have + F.when(_pred(m).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return have


def abs_error_sums(
    rows: DataFrame, models: Sequence[str], points: np.ndarray, by: Sequence[str] = ()
) -> DataFrame:
    """``by``, ``_have``, ``_point``, ``_n``, ``_sum``: summed absolute errors of blends at ``points``.

    Absolute errors have no algebra, but rows are not repeated either: a task adds
    the errors of a block of rows at all points to one array for each ``by`` and
    presence pattern, by matrix products, and only the arrays are shuffled. A
    pattern has the points that give its absent models no weight.
    """
    names = [f"_by{i}" for i in range(len(by))]
    need = (points != 0) @ (1 << np.arange(len(models)))
    flat = _with_truth(rows).select(
        *[F.col(c).alias(n) for c, n in zip(by, names)], _patterns(models).alias("_have"),
        F.col("y_true").cast("double").alias("_y"), *[_pred(m).cast("double").alias(f"_p{i}") for i, m in enumerate(models)],
    )
    width = len(by) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in held], flat_types[i]) for i in range(width)]
            sums = pa.array([v[1] for v in held.values()], pa.list_(pa.float64()))
            n = pa.array([v[0] for v in held.values()], pa.int64())
            return pa.RecordBatch.from_arrays([*keys, n, sums], [*names, "_have", "_n", "_sums"])

        flat_types = None
        for batch in batches:
            flat_types = [c.type for c in batch.columns[:width]]
            y = batch.column(width).to_numpy()
            # an absent model has no weight where the sum counts
            p = np.stack([c.fill_null(0.0).to_numpy() for c in batch.columns[width + 1 :]], axis=1)
            code = np.zeros(len(y), np.int64)
            for column in batch.columns[:width]:
                encoded = column.dictionary_encode(null_encoding="encode")
                code = code * len(encoded.dictionary) + encoded.indices.to_numpy()
            _, first, group = np.unique(code, return_index=True, return_inverse=True)
            for g, at in enumerate(first):
                key = tuple(c[int(at)].as_py() for c in batch.columns[:width])
                fits = np.flatnonzero((need & ~np.int64(key[-1])) == 0)
                mine = np.flatnonzero(group == g)
                if key not in held:
                    held[key] = [0, np.zeros(len(points))]
                held[key][0] += len(mine)
                for a in range(0, len(mine), BLOCK):
                    block = mine[a : a + BLOCK]
                    held[key][1][fits] += np.abs(y[block, None] - p[block] @ points[fits].T).sum(axis=0)
                if len(held) * len(points) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields[:width]]
    found = flat.mapInArrow(run, ", ".join([*kinds, "_n long", "_sums array<double>"]))
    needs = F.array(*[F.lit(int(x)) for x in need])
    return (
        found.select(*[F.col(n).alias(c) for n, c in zip(names, by)], "_have", "_n", F.posexplode("_sums").alias("_point", "_s"))
        .where(F.get(needs, F.col("_point")).bitwiseAND(F.bitwise_not(F.col("_have"))) == 0)
        .groupBy(*by, "_have", "_point").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_sum"))
    )


def _with_points(sums: DataFrame, models: Sequence[str], points: np.ndarray) -> DataFrame:
    """``w_{model}`` of each ``_point``; the points are a parameter, not data."""
    columns = {f"w_{m}": F.get(F.array(*[F.lit(float(x)) for x in points[:, i]]), F.col("_point")) for i, m in enumerate(models)}
    return sums.withColumns(columns)


def _mean_abs_errors(aligned: DataFrame, models: Sequence[str], points: np.ndarray, by: Sequence[str]) -> DataFrame:
    """Rows that lack a model have no blend and are not counted."""
    sums = abs_error_sums(aligned.where(_patterns(models) == (1 << len(models)) - 1), models, points, by)
    found = _with_points(sums, models, points).withColumn("mae", F.col("_sum") / F.col("_n"))
    return found.select(*by, "_point", *map(_weight, models), F.col("_n").alias("n"), "mae")


def score_random_weights(
    aligned: DataFrame,
    models: Sequence[str],
    trials: int = 100,
    seed: int = 42,
    by: Sequence[str] = (),
    metric: str = "rmse",
) -> DataFrame:
    """Score of ``trials`` random weight vectors, per ``by``."""
    if metric == "mae":
        drawn = explode_random_weights(aligned.sparkSession.range(1).drop("id"), models, trials, seed)
        points = np.array([tuple(r)[1:] for r in drawn.orderBy("trial").collect()])  # ``trials`` rows
        found = _mean_abs_errors(aligned, models, points, by)
        return found.withColumn("trial", F.col("_point") + 1).drop("_point")
    if metric != "rmse":
        raise ValueError(f"metric {metric!r} is not supported, use rmse or mae")
    gram = error_products(aligned, models, by)
    scored = explode_random_weights(gram, models, trials, seed)
    return _drop_products(scored.withColumn("rmse", blend_rmse(models)), models)


def _comparable(metric: str) -> Column:
    """The score to 12 digits, so that equal blends tie despite rounding noise."""
    return F.format_string("%.11e", F.col(metric)).cast("double")


def best_weights(
    scored: DataFrame, models: Sequence[str], metric: str = "rmse", by: Sequence[str] = ()
) -> DataFrame:
    """The lowest score per ``by``; among equals the first in grid order."""
    weights = [_weight(m) for m in models]
    rest = [c for c in scored.columns if c not in by]
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(_comparable(metric), *weights)).alias("_best")
    return scored.groupBy(*by).agg(best).select(*by, "_best.*")


def subsets(models: Sequence[str], smallest: int = 2, largest: int | None = None) -> list[tuple[str, ...]]:
    """Model subsets by size, then in the order of ``models``."""
    largest = len(models) if largest is None else largest
    return [s for k in range(smallest, largest + 1) for s in combinations(models, k)]


def score_subsets(
    outer: DataFrame,
    models: Sequence[str],
    smallest: int = 2,
    largest: int | None = None,
    steps: int = 11,
    metric: str = "rmse",
) -> DataFrame:
    """Every model subset with every weight vector, each on the rows that all its
    members forecast.

    ``outer`` keeps absent models as NULL. For RMSE the forecasts are summed once
    per presence pattern (at most 2^models groups); a subset adds up the patterns
    that contain it. For MAE the same holds of the summed errors at each grid point.
    """
    bits = {m: 1 << i for i, m in enumerate(models)}
    chosen = F.array(
        *[
            F.struct(
                F.lit(i).alias("subset_no"),
                F.lit("+".join(s)).alias("subset"),
                F.lit(len(s)).alias("num_models"),
                F.lit(sum(bits[m] for m in s)).alias("_need"),
            )
            for i, s in enumerate(subsets(models, smallest, largest), start=1)
        ]
    )
    covered = F.col("_have").bitwiseAND(F.col("_need")) == F.col("_need")
    member = {m: F.col("_need").bitwiseAND(F.lit(b)) != 0 for m, b in bits.items()}
    label = ["subset_no", "subset", "num_models", "_need"]
    if metric == "rmse":
        patterns = error_products(outer.withColumn("_have", _patterns(models)), models, ["_have"])
        sums = [_gram(a, b) for a, b in _pairs(models)]
        gram = (
            patterns.select("*", F.inline(chosen))
            .where(covered)
            .groupBy(*label)
            .agg(F.sum("n").alias("n"), *[F.sum(f"`{s}`").alias(s) for s in sums])
        )
        scored = explode_weight_grid(gram, models, steps, member)
        return _drop_products(scored.withColumn("rmse", blend_rmse(models)), models).drop("_need")
    if metric == "mae":
        points = simplex_points(len(models), steps)
        support = F.array(*[F.lit(int(x)) for x in (points != 0) @ (1 << np.arange(len(models)))])
        sums = abs_error_sums(outer, models, points).withColumn("_support", F.get(support, F.col("_point")))

        def within(s: Column) -> Column:  # support within subset within pattern
            need = s["_need"]
            return (need.bitwiseAND(F.col("_have")) == need) & (need.bitwiseAND(F.col("_support")) == F.col("_support"))

        scored = (
            sums.select("_point", "_n", "_sum", F.inline(F.filter(chosen, within)))
            .groupBy(*label, "_point").agg(F.sum("_n").alias("n"), F.sum("_sum").alias("_sum"))
            .withColumn("mae", F.col("_sum") / F.col("n"))
        )
        return _with_points(scored, models, points).drop("_need", "_point", "_sum")
    raise ValueError(f"metric {metric!r} is not supported, use rmse or mae")


def best_subset(scored: DataFrame, models: Sequence[str], metric: str = "rmse") -> DataFrame:
    """The best subset and weights; among equals the smaller, earlier subset."""
    weights = [_weight(m) for m in models]
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in scored.columns]), F.struct(_comparable(metric), "subset_no", *weights))
    return scored.agg(best.alias("_best")).select("_best.*")
