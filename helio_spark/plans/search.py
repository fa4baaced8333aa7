"""Parameter grids, walk-forward trials and leaderboards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helio_spark.functions.scores import mae, rmse, skill
from helio_spark.operators.forecasts import horizon_metrics, naive_scale
from helio_spark.operators.ordering import IDX, SERIES
from helio_spark.operators.splits import TRAIN, VAL, walk_forward
from helio_spark.plans.boosting import Spec, fit_boosted, predict_boosted
from helio_spark.plans.training import fit_horizons, predict_long


def parameter_grid(spark: SparkSession, values: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the values, with ``run_id`` from 1 in grid order."""
    grid = spark.range(1).drop("id")
    place = F.lit(0)
    for name, options in values.items():
        item = f"_at_{name}"
        grid = grid.select("*", F.posexplode(F.array(*map(F.lit, options))).alias(item, name))
        place = place * len(options) + F.col(item)
    return grid.select((place + 1).alias("run_id"), *values)


def remaining(grid: DataFrame, done: DataFrame, params: Sequence[str]) -> DataFrame:
    """Grid points without a finished trial; ids stay those of the grid."""
    return grid.join(done.select(*params), list(params), "left_anti").select(*grid.columns)


def leaderboard(
    trials: DataFrame, metric: str = "rmse", baseline: float | None = None, failed: str = "failed"
) -> DataFrame:
    """Finished trials with the improvement over a baseline, best first."""
    ok = trials.where((F.col("status") != failed) & F.col(metric).isNotNull())
    gain = F.lit(None).cast("double") if baseline is None else skill(F.col(metric), F.lit(baseline))
    return ok.withColumn("improvement_pct", gain).orderBy(metric, "run_id")


def best_trial(trials: DataFrame, metric: str = "rmse", failed: str = "failed") -> DataFrame:
    ok = trials.where((F.col("status") != failed) & F.col(metric).isNotNull())
    best = F.min_by(F.struct(*trials.columns), F.struct(metric, "run_id"))
    return ok.agg(best.alias("_best")).select("_best.*")


def run_trials(
    rows: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int],
    grid: DataFrame,
    done: DataFrame | None = None,
    **fixed,
) -> DataFrame:
    """Fit each grid point on the train rows and score it on the val rows.

    ``rows`` carries ``split``, targets and ``pv``. Points in ``done`` are skipped;
    a point whose settings the learner refuses is recorded as ``failed`` with the
    reason; any other error ends the search. The loop is over settings
    (a small table); every fit and score is a Spark job over all rows.
    """
    params = [c for c in grid.columns if c != "run_id"]
    todo = grid if done is None else remaining(grid, done, params)
    scale = naive_scale(rows.where(F.col("split") == TRAIN).select(SERIES, IDX, "pv")).persist()
    results = []
    for point in todo.orderBy("run_id").collect():
        setting = {p: point[p] for p in params}
        try:
            models = fit_horizons(rows, features, horizons, **fixed, **setting)
            scored = predict_long(rows.where(F.col("split") == VAL), models, features)
            best = (
                scored.groupBy(SERIES, "horizon_h")
                .agg(rmse("y_true", "y_pred").alias("rmse"), mae("y_true", "y_pred").alias("mae"))
                .join(scale, SERIES, "left")
                .agg(F.avg("rmse").alias("rmse"), F.avg(F.col("mae") / F.col("scale")).alias("mase"))
                .first()
            )
            outcome = (best["rmse"], best["mase"], "ok", None)
        except (IllegalArgumentException, TypeError, ValueError) as error:
            outcome = (None, None, "failed", str(error)[:500])
        results.append((point["run_id"], *setting.values(), *outcome))
    scale.unpersist()
    types = {f.name: f.dataType.simpleString() for f in grid.schema.fields}
    schema = ", ".join(
        [f"run_id {types['run_id']}", *[f"{p} {types[p]}" for p in params]]
        + ["rmse double", "mase double", "status string", "reason string"]
    )
    return grid.sparkSession.createDataFrame(results, schema)


def boosted_trials(
    rows: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    grid: DataFrame,
    segment: Column,
    scale: DataFrame,
    done: DataFrame | None = None,
    **fixed,
) -> DataFrame:
    """Fit and score every grid point together: the scans do not grow with the number of settings.

    A point's models (one for each target, ``target_h{h}`` in order of h) are those that ``fit_boosted``
    gives for it alone. They are scored on the rows of segment 1: run_id, the parameters, rmse and mase
    (means over series and horizons), status and reason. Points in ``done`` are skipped; settings that ``Spec``
    refuses are ``failed`` with the reason.
    """
    params = [c for c in grid.columns if c != "run_id"]
    todo = (grid if done is None else remaining(grid, done, params)).orderBy("run_id").collect()
    specs, run_of, failed = [], [], []
    for point in todo:
        try:
            mine = [Spec(target=t, **{**fixed, **{p: point[p] for p in params}}) for t in range(len(targets))]
        except (TypeError, ValueError) as error:
            failed.append((point["run_id"], str(error)[:500]))
            continue
        specs += mine
        run_of += [point["run_id"]] * len(mine)
    spark = grid.sparkSession
    refused = spark.createDataFrame(failed, "run_id long, reason string")
    out = grid.join(refused, "run_id").select(
        *grid.columns, F.lit(None).cast("double").alias("rmse"), F.lit(None).cast("double").alias("mase"), F.lit("failed").alias("status"), "reason"
    )
    if not specs:
        return out
    boosted = fit_boosted(rows, features, targets, specs, segment)
    horizons = {i: s.target + 1 for i, s in enumerate(specs)}
    scored = predict_boosted(rows.where(segment == 1), boosted, horizons)
    runs = F.array(*[F.lit(r).cast("long") for r in run_of])
    per = (
        scored.withColumn("run_id", F.get(runs, F.col("model"))).groupBy("run_id", SERIES, "horizon_h")
        .agg(rmse("y_true", "y_pred").alias("rmse"), mae("y_true", "y_pred").alias("mae"))
        .join(scale, SERIES, "left").groupBy("run_id")
        .agg(F.avg("rmse").alias("rmse"), F.avg(F.col("mae") / F.col("scale")).alias("mase"))
    )
    ok = grid.join(per, "run_id").select(*grid.columns, "rmse", "mase", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
    return ok.unionByName(out)


def walk_forward_scores(
    df: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int],
    folds: int,
    val_frac: float = 0.1,
    **params,
) -> DataFrame:
    """Metrics per fold, series and horizon of models refitted on each fold.

    ``df`` carries targets, ``pv`` and ``y_naive_h{h}`` for each horizon.
    """
    rows = walk_forward(df, folds, val_frac)
    out = None
    for fold in range(1, folds + 1):
        part = rows.where(F.col("fold") == fold).withColumn("split", F.col("role"))
        if part.isEmpty():
            break
        models = fit_horizons(part, features, horizons, **params)
        naive = [f"y_naive_h{h}" for h in horizons]
        scored = predict_long(part.where(F.col("split") == VAL), models, features, keep=naive)
        by_h = F.coalesce(
            *[F.when(F.col("horizon_h") == h, F.col(f"y_naive_h{h}")) for h in horizons]
        )
        scale = naive_scale(part.where(F.col("split") == TRAIN).select(SERIES, IDX, "pv"))
        metrics = horizon_metrics(scored.withColumn("y_naive", by_h), scale).withColumn(
            "fold", F.lit(fold)
        )
        out = metrics if out is None else out.unionByName(metrics)
    if out is None:
        raise ValueError("the series are too short for one fold")
    return out
