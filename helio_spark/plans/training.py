"""One boosted-tree regressor per horizon, scoring and importance (MLlib)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helio_spark.functions.scores import skill
from helio_spark.functions.solar import raw_solar_weight
from helio_spark.functions.time import forecast_time
from helio_spark.operators.clean import conform
from helio_spark.operators.forecasts import horizon_metrics
from helio_spark.operators.framing import latest_origin
from helio_spark.operators.ordering import IDX, SERIES, TS
from helio_spark.operators.splits import TRAIN, VAL
from helio_spark.plans.boosting import Boosted, predict_boosted

FEATURES = "features"
WEIGHT = "weight"


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``features`` as a vector; a missing value stays NaN."""
    filled = df.withColumns(
        {f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features}
    )
    assembler = VectorAssembler(
        inputCols=[f"_f_{c}" for c in features], outputCol=FEATURES, handleInvalid="keep"
    )
    return assembler.transform(filled).drop(*[f"_f_{c}" for c in features])


def train_weights(df: DataFrame, zenith: str = "sp_zenith") -> DataFrame:
    """Solar weights with mean 1 over the train rows; 1 without a zenith."""
    if zenith not in df.columns:
        return df.withColumn(WEIGHT, F.lit(1.0))
    weighted = df.withColumn("_raw", F.coalesce(raw_solar_weight(F.col(zenith)), F.lit(1.0)))
    mean = weighted.where(F.col("split") == TRAIN).agg(F.avg("_raw")).first()[0] or 1.0
    return weighted.withColumn(WEIGHT, F.col("_raw") / F.lit(mean)).drop("_raw")


def fit_horizons(
    df: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int],
    parallel: int = 4,
    seed: int = 42,
    **params,
) -> dict[int, GBTRegressionModel]:
    """Fit ``target_h{h}`` on the train rows, stopping early on the val rows.

    ``df`` carries ``split`` and the targets. The vectors are built once and kept
    for all fits; the fits are independent Spark jobs submitted side by side.
    """
    options = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.9, **params}
    ready = (
        assemble(train_weights(df.where(F.col("split").isin(TRAIN, VAL))), features)
        .select(
            FEATURES,
            WEIGHT,
            (F.col("split") == VAL).alias("is_val"),
            *[f"target_h{h}" for h in horizons],
        )
        .persist()
    )

    def fit(h: int) -> GBTRegressionModel:
        label = f"target_h{h}"
        booster = GBTRegressor(
            featuresCol=FEATURES,
            labelCol=label,
            predictionCol="y_pred",
            weightCol=WEIGHT,
            validationIndicatorCol="is_val",
            seed=seed,
            **options,
        )
        return booster.fit(ready.where(F.col(label).isNotNull()))

    try:
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            fitted = pool.map(inheritable_thread_target(df.sparkSession)(fit), horizons)
            return dict(zip(horizons, fitted))
    finally:
        ready.unpersist()


def predict_long(
    df: DataFrame,
    models: Mapping[int, GBTRegressionModel],
    features: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Long forecasts of all models; one pass over the rows."""
    scored = assemble(df, features)
    for h, model in models.items():
        scored = model.copy({model.predictionCol: f"_p_{h}"}).transform(scored)
    per_h = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon_h"),
                (
                    F.col(f"target_h{h}") if f"target_h{h}" in df.columns
                    else F.lit(None).cast("double")
                ).alias("y_true"),
                F.col(f"_p_{h}").alias("y_pred"),
            )
            for h in models
        ]
    )
    return (
        scored.select(SERIES, IDX, F.col(TS).alias("origin_ts"), *keep, F.inline(per_h))
        .withColumn("forecast_ts", forecast_time(F.col("origin_ts"), F.col("horizon_h")))
        .select(
            SERIES, IDX, "origin_ts", "forecast_ts", "horizon_h", *keep, "y_true", "y_pred"
        )
    )


def feature_importance(
    df: DataFrame, models: Mapping[int, GBTRegressionModel], features: Sequence[str], top: int = 15
) -> DataFrame:
    """Importance averaged over the horizons, the ``top`` features first."""
    rows = [
        (h, name, float(value))
        for h, model in models.items()
        for name, value in zip(features, model.featureImportances.toArray())
    ]
    table = df.sparkSession.createDataFrame(rows, "horizon_h int, feature string, importance double")
    return (
        table.groupBy("feature")
        .agg(F.avg("importance").alias("importance"))
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )


def next_day(
    df: DataFrame, models: Mapping[int, GBTRegressionModel], features: Sequence[str]
) -> DataFrame:
    """Forecasts from the newest measured row of every series."""
    origins = latest_origin(df)
    if IDX not in origins.columns:
        origins = origins.withColumn(IDX, F.lit(None).cast("long"))
    return predict_long(conform(origins, features, keep=(SERIES, TS, IDX)), models, features).drop(
        "y_true"
    )


def backtest(
    rows: DataFrame,
    boosted: Boosted,
    horizons: Mapping[int, int],
    scale: DataFrame,
    by: Sequence[str] = (SERIES, "horizon_h"),
    fold: str | None = None,
) -> DataFrame:
    """RMSE and MASE of the models and of persistence per ``by``, with the skill in percent.

    ``rows`` carry the features, ``target_h{h}`` and ``y_naive_h{h}`` of each horizon; ``scale`` is from the
    train rows. With ``fold`` each row is forecast by the models of its fold.
    """
    scored = predict_boosted(rows, boosted, horizons, keep=[] if fold is None else [fold], fold=fold, ahead=["y_naive"])
    if fold is not None:
        scored = scored.withColumn("fold", F.col(fold))
    metrics = horizon_metrics(scored, scale, by=by)
    return metrics.withColumn("skill_pct", skill(F.col("rmse_model"), F.col("rmse_naive")))
