"""From several models' forecasts to a chosen blend and its scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helio_spark.functions import scores
from helio_spark.operators.blending import (
    best_subset,
    best_weights,
    blend,
    score_random_weights,
    score_subsets,
    score_weight_grid,
    subsets,
)
from helio_spark.operators.forecasts import align_forecasts, stack_models, unpivot_models
from helio_spark.operators.optimum import optimal_weights
from helio_spark.operators.ordering import SERIES


def choose_weights(
    validation: Mapping[str, DataFrame],
    method: str = "grid",
    metric: str = "rmse",
    steps: int = 11,
    trials: int = 100,
    smallest: int = 2,
) -> dict[str, float]:
    """Weights by model, from the validation forecasts.

    ``method``: ``grid`` (all models), ``random`` (all models, seeded trials),
    ``exhaustive`` (every subset of at least ``smallest`` models) or ``optimal`` (the
    minimum over all weights, not only those of a grid).
    """
    models = list(validation)
    stacked = stack_models(validation)
    if method == "exhaustive":
        outer = align_forecasts(stacked, models, complete=False)
        best = best_subset(
            score_subsets(outer, models, smallest, steps=steps, metric=metric), models, metric
        ).first()
        members = list(subsets(models, smallest)[best["subset_no"] - 1])
    else:
        aligned = align_forecasts(stacked, models)
        if method == "optimal":
            found = optimal_weights(aligned, models, metric).first()
            return {m: found[f"w_{m}"] for m in models}
        if method == "grid":
            scored = score_weight_grid(aligned, models, steps, metric)
        elif method == "random":
            scored = score_random_weights(aligned, models, trials, metric=metric)
        else:
            raise ValueError(f"unknown method {method!r}")
        best = best_weights(scored, models, metric).first()
        members = models
    return {m: best[f"w_{m}"] for m in members}


def apply_weights(test: Mapping[str, DataFrame], weights: Mapping[str, float]) -> DataFrame:
    """Blend the test forecasts with the weights chosen on validation."""
    members = {m: test[m] for m in weights}
    return blend(align_forecasts(stack_models(members), list(weights)), weights)


def _tall(blended: DataFrame, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row for each member and for the blend (``ensemble``)."""
    members = [F.col(f"`pred_{m}`").alias(m) for m in models]
    named = blended.select(*keep, "y_true", *members, F.col("y_pred").alias("ensemble"))
    return unpivot_models(named, [*models, "ensemble"])


def compare_members(
    blended: DataFrame, models: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """RMSE and MAE of each member and of the blend on the same rows."""
    return _tall(blended, models, by).groupBy(*by, "model").agg(
        F.count(F.lit(1)).alias("n"),
        scores.rmse("y_true", "y_pred").alias("rmse"),
        scores.mae("y_true", "y_pred").alias("mae"),
    )


def blend_scores(
    blended: DataFrame, models: Sequence[str], scale: DataFrame, series: str = SERIES
) -> DataFrame:
    """RMSE, MAE and MASE of each member and of the blend, per horizon and over all (``horizon_h`` NULL).

    ``scale`` (see ``naive_scale``) is of the train rows of each series; a series without one has
    no MASE. All levels come from one pass.
    """
    tall = _tall(blended, models, [series, "horizon_h"])
    keys = [series, "model"]
    scored = tall.groupingSets([[*keys, "horizon_h"], keys], *keys, "horizon_h").agg(
        F.count(F.lit(1)).alias("n"),
        scores.rmse("y_true", "y_pred").alias("rmse"),
        scores.mae("y_true", "y_pred").alias("mae"),
    )
    return scored.join(scale, series, "left").withColumn("mase", F.col("mae") / F.col("scale")).drop("scale")
