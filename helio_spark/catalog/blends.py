"""Forecast alignment, blending and weight search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helio_spark.catalog.inputs import BLEND_HORIZON, METHODS, MODELS, forecasts_sql, model_tables, raw, rounded, tidy
from helio_spark.catalog.registry import query
from helio_spark.operators.blending import (
    best_subset,
    best_weights,
    blend,
    blend_stacked,
    score_random_weights,
    score_subsets,
    score_weight_grid,
)
from helio_spark.operators.forecasts import KEYS, PLACES, Persistence, RecentMean, align_forecasts, long_forecasts, made_by, naive_scale, stack_models, with_fallback
from helio_spark.operators.optimum import optimal_weights
from helio_spark.operators.splits import TRAIN, split_rows
from helio_spark.plans.evaluation import apply_weights, blend_scores, choose_weights, compare_members

_FC = forecasts_sql(BLEND_HORIZON)
_FULL = f"{_FC}, af AS (SELECT * FROM fc WHERE day IS NOT NULL AND week IS NOT NULL)"
_PREDS = ("day AS pred_day", "week AS pred_week", "mean AS pred_mean")
_GRID = """
    k AS (SELECT unnest(generate_series(0, 10)) AS k),
    gw AS (SELECT a.k / 10.0::DOUBLE AS w_day, b.k / 10.0::DOUBLE AS w_week,
                  (10 - a.k - b.k) / 10.0::DOUBLE AS w_mean
           FROM k a, k b WHERE a.k + b.k <= 10)"""
_BLEND = "w_day * day + w_week * week + w_mean * mean"
_BLEND_RMSE = f"sqrt(avg((y_true - ({_BLEND})) ** 2))"
_WEIGHTS = ("w_day", "w_week", "w_mean")


def _aligned(spark, sf_dir, complete=True):
    return align_forecasts(stack_models(model_tables(spark, sf_dir)), MODELS, complete)


@query(
    "align_forecasts",
    f"WITH {_FULL} SELECT series_id, origin_ts, horizon_h, {rounded('y_true', *_PREDS)} FROM af",
)
def aligned(spark, sf_dir):
    return tidy(_aligned(spark, sf_dir))


@query(
    "blend",
    f"""
    WITH {_FULL} SELECT series_id, origin_ts, horizon_h, {rounded('y_true', *_PREDS,
        '0.3 * day + 0.2 * week + 0.5 * mean AS y_pred')} FROM af""",
)
def blended(spark, sf_dir):
    return tidy(blend(_aligned(spark, sf_dir), {"day": 0.3, "week": 0.2, "mean": 0.5}))


@query(
    "blend_stacked",
    f"""
    WITH {_FULL} SELECT series_id, origin_ts, horizon_h,
        {rounded('y_true', '0.25 * week + 0.75 * day AS y_pred')} FROM af""",
)
def stacked_blend(spark, sf_dir):
    """Long rows joined with a weight table, for forecasts that all members made."""
    tables = model_tables(spark, sf_dir)
    at = ["series_id", "time_idx", "horizon_h"]  # events of one time are origins of their own
    stacked = stack_models({"day": tables["day"], "week": tables["week"]}, PLACES)
    weights = spark.createDataFrame([("week", 0.25), ("day", 0.75)], "model string, weight double")
    common = made_by(stacked, "week", at)
    return tidy(blend_stacked(common, weights, PLACES).drop("time_idx"))


@query(
    "blend_fallback",
    f"""
    WITH {_FC} SELECT series_id, origin_ts, horizon_h,
        {rounded('day AS y_pred', '0.4 * coalesce(week, day) + 0.6 * day AS y_pred_ensemble')}
    FROM fc WHERE day IS NOT NULL""",
)
def fallback(spark, sf_dir):
    tables = model_tables(spark, sf_dir)
    made = with_fallback(tables["day"], tables["week"], 0.4)
    return tidy(made.select(*KEYS, "y_pred", "y_pred_ensemble"))


@query(
    "weight_grid",
    f"""
    WITH {_FULL}, {_GRID}
    SELECT {rounded(*_WEIGHTS, _BLEND_RMSE + ' AS rmse')}, count(*) AS n
    FROM af CROSS JOIN gw GROUP BY w_day, w_week, w_mean""",
)
def weight_grid(spark, sf_dir):
    return tidy(score_weight_grid(_aligned(spark, sf_dir), MODELS))


@query(
    "weight_grid_mae",
    f"""
    WITH {_FULL}, {_GRID}
    SELECT {rounded(*_WEIGHTS, f'avg(abs(y_true - ({_BLEND}))) AS mae')}, count(*) AS n
    FROM af CROSS JOIN gw GROUP BY w_day, w_week, w_mean""",
)
def weight_grid_mae(spark, sf_dir):
    return tidy(score_weight_grid(_aligned(spark, sf_dir), MODELS, metric="mae"))


@query(
    "best_weights",
    f"""
    WITH {_FULL}, {_GRID},
    s AS (SELECT w_day, w_week, w_mean, {_BLEND_RMSE} AS rmse, count(*) AS n
          FROM af CROSS JOIN gw GROUP BY 1, 2, 3)
    SELECT n, {rounded(*_WEIGHTS, 'rmse')} FROM s
    ORDER BY round(rmse, 12), w_day, w_week, w_mean LIMIT 1""",
)
def best(spark, sf_dir):
    return tidy(best_weights(score_weight_grid(_aligned(spark, sf_dir), MODELS), MODELS))


@query(
    "weights_by_horizon",
    f"""
    WITH {_FULL}, {_GRID},
    s AS (SELECT horizon_h, w_day, w_week, w_mean, {_BLEND_RMSE} AS rmse, count(*) AS n
          FROM af CROSS JOIN gw GROUP BY 1, 2, 3, 4),
    k2 AS (SELECT *, row_number() OVER (PARTITION BY horizon_h
                      ORDER BY round(rmse, 12), w_day, w_week, w_mean) AS rn FROM s)
    SELECT horizon_h, n, {rounded(*_WEIGHTS, 'rmse')} FROM k2 WHERE rn = 1""",
)
def weights_by_horizon(spark, sf_dir):
    scored = score_weight_grid(_aligned(spark, sf_dir), MODELS, by=["horizon_h"])
    return tidy(best_weights(scored, MODELS, by=["horizon_h"]))


_UNIFORM = "CAST('0x' || substr(md5('42-' || t || '-{i}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(
    "random_weights",
    f"""
    WITH {_FULL},
    u AS (SELECT t, {_UNIFORM.format(i=0)} AS a, {_UNIFORM.format(i=1)} AS b
          FROM (SELECT unnest(generate_series(1, 100)) AS t)),
    rw AS (SELECT t AS trial, a AS w_day, b * (1 - a) AS w_week, 1 - a - b * (1 - a) AS w_mean FROM u)
    SELECT trial, count(*) AS n, {rounded(*_WEIGHTS, _BLEND_RMSE + ' AS rmse')}
    FROM af CROSS JOIN rw GROUP BY trial, w_day, w_week, w_mean""",
)
def random_weights(spark, sf_dir):
    return tidy(score_random_weights(_aligned(spark, sf_dir), MODELS))


@query(
    "random_weights_mae",
    f"""
    WITH {_FULL},
    u AS (SELECT t, {_UNIFORM.format(i=0)} AS a, {_UNIFORM.format(i=1)} AS b
          FROM (SELECT unnest(generate_series(1, 100)) AS t)),
    rw AS (SELECT t AS trial, a AS w_day, b * (1 - a) AS w_week, 1 - a - b * (1 - a) AS w_mean FROM u)
    SELECT trial, count(*) AS n, {rounded(*_WEIGHTS, f'avg(abs(y_true - ({_BLEND}))) AS mae')}
    FROM af CROSS JOIN rw GROUP BY trial, w_day, w_week, w_mean""",
)
def random_weights_mae(spark, sf_dir):
    return tidy(score_random_weights(_aligned(spark, sf_dir), MODELS, metric="mae"))


# rows whose truth is below this value count as not measured yet
_UNSEEN = 0.02
_SEEN = f"af2 AS (SELECT * FROM af WHERE y_true >= {_UNSEEN})"


def _partly_measured(rows):
    return rows.withColumn("y_true", F.when(F.col("y_true") >= _UNSEEN, F.col("y_true")))


@query(
    "weight_grid_unmeasured",
    f"""
    WITH {_FULL}, {_GRID}, {_SEEN}
    SELECT {rounded(*_WEIGHTS, _BLEND_RMSE + ' AS rmse', f'avg(abs(y_true - ({_BLEND}))) AS mae')}, count(*) AS n
    FROM af2 CROSS JOIN gw GROUP BY w_day, w_week, w_mean""",
)
def weight_grid_unmeasured(spark, sf_dir):
    """Both metrics where some forecasts have no truth yet."""
    rows = _partly_measured(_aligned(spark, sf_dir))
    keys = ["w_day", "w_week", "w_mean", "n"]
    rmse, mae = (score_weight_grid(rows, MODELS, metric=m).select(*[F.round(k, 6).alias(k) for k in keys], m) for m in ("rmse", "mae"))
    return tidy(rmse.join(mae, keys))


_SUBSETS_SQL = f"""{_FC}, {_GRID},
    ss(subset_no, subset, num_models, d, w, m) AS (
      VALUES (CAST(1 AS BIGINT), 'day+week', CAST(2 AS BIGINT), 1, 1, 0), (2, 'day+mean', 2, 1, 0, 1), (3, 'week+mean', 2, 0, 1, 1),
             (4, 'day+week+mean', 3, 1, 1, 1)),
    sg AS (SELECT * FROM ss, gw WHERE (d = 1 OR w_day = 0) AND (w = 1 OR w_week = 0)
                                  AND (m = 1 OR w_mean = 0)),
    e AS (SELECT subset_no, subset, num_models, w_day, w_week, w_mean,
                 y_true - (w_day * coalesce(day, 0) + w_week * coalesce(week, 0) + w_mean * mean) AS err
          FROM fc, sg WHERE (d = 0 OR day IS NOT NULL) AND (w = 0 OR week IS NOT NULL))"""


@query(
    "subset_search",
    f"""
    WITH {_SUBSETS_SQL}
    SELECT subset_no, subset, num_models, count(*) AS n,
           {rounded(*_WEIGHTS, 'sqrt(avg(err ** 2)) AS rmse')}
    FROM e GROUP BY subset_no, subset, num_models, w_day, w_week, w_mean""",
)
def subset_search(spark, sf_dir):
    return tidy(score_subsets(_aligned(spark, sf_dir, complete=False), MODELS))


@query(
    "subset_search_mae",
    f"""
    WITH {_SUBSETS_SQL}
    SELECT subset_no, subset, num_models, count(*) AS n,
           {rounded(*_WEIGHTS, 'avg(abs(err)) AS mae')}
    FROM e GROUP BY subset_no, subset, num_models, w_day, w_week, w_mean""",
)
def subset_search_mae(spark, sf_dir):
    return tidy(score_subsets(_aligned(spark, sf_dir, complete=False), MODELS, metric="mae"))


@query(
    "best_subset",
    f"""
    WITH {_SUBSETS_SQL},
    s AS (SELECT subset_no, subset, num_models, w_day, w_week, w_mean, count(*) AS n,
                 sqrt(avg(err ** 2)) AS rmse FROM e GROUP BY 1, 2, 3, 4, 5, 6)
    SELECT subset_no, subset, num_models, n, {rounded(*_WEIGHTS, 'rmse')} FROM s
    ORDER BY round(rmse, 12), subset_no, w_day, w_week, w_mean LIMIT 1""",
)
def subset_best(spark, sf_dir):
    return tidy(best_subset(score_subsets(_aligned(spark, sf_dir, complete=False), MODELS), MODELS))


_MEMBERS = {"day": "day", "week": "week", "mean": "mean", "ensemble": "(0.3 * day + 0.2 * week + 0.5 * mean)"}


@query(
    "compare_members",
    f"WITH {_FULL} "
    + " UNION ALL ".join(
        f"SELECT horizon_h, '{m}' AS model, count(*) AS n, "
        + rounded(f"sqrt(avg((y_true - {p}) ** 2)) AS rmse", f"avg(abs(y_true - {p})) AS mae")
        + " FROM af GROUP BY horizon_h"
        for m, p in _MEMBERS.items()
    ),
)
def members(spark, sf_dir):
    made = blend(_aligned(spark, sf_dir), {"day": 0.3, "week": 0.2, "mean": 0.5})
    return tidy(compare_members(made, MODELS, by=["horizon_h"]))


@query(
    "blend_scores",
    f"""
    WITH {_FULL},
    lg AS (SELECT series_id, pv, lag(pv, 24) OVER (PARTITION BY series_id ORDER BY time_idx) AS l FROM sp WHERE split = 'train'),
    sc AS (SELECT series_id, avg(abs(pv - l)) AS scale FROM lg GROUP BY 1),
    tl AS ("""
    + " UNION ALL ".join(f"SELECT series_id, horizon_h, '{m}' AS model, y_true, {p} AS p FROM af WHERE split = 'test'" for m, p in _MEMBERS.items())
    + f""")
    SELECT series_id, model, horizon_h, n, {rounded('rmse', 'mae', 'mae / scale AS mase')}
    FROM (SELECT series_id, model, horizon_h, count(*) AS n, sqrt(avg((y_true - p) ** 2)) AS rmse, avg(abs(y_true - p)) AS mae
          FROM tl GROUP BY GROUPING SETS ((series_id, model, horizon_h), (series_id, model))) JOIN sc USING (series_id)""",
)
def scores_of_blend(spark, sf_dir):
    """The blend and its members on the test rows, per horizon and over all, with MASE."""
    test = model_tables(spark, sf_dir, "test")
    made = apply_weights(test, {"day": 0.3, "week": 0.2, "mean": 0.5})
    train = split_rows(raw(spark, sf_dir).select("series_id", "time_idx", "pv")).where(F.col("split") == TRAIN)
    return tidy(blend_scores(made, MODELS, naive_scale(train)))


_TEST_MEMBERS = {**{m: m for m in MODELS}, "ensemble": f"({_BLEND})"}


@query(
    "validated_blend",
    f"""
    WITH {_FULL}, {_GRID},
    s AS (SELECT w_day, w_week, w_mean, {_BLEND_RMSE} AS rmse
          FROM af CROSS JOIN gw WHERE split = 'val' GROUP BY 1, 2, 3),
    b AS (SELECT w_day, w_week, w_mean FROM s ORDER BY round(rmse, 12), w_day, w_week, w_mean LIMIT 1),
    te AS (SELECT * FROM af CROSS JOIN b WHERE split = 'test')
    """
    + " UNION ALL ".join(
        f"SELECT '{m}' AS model, count(*) AS n, "
        + rounded(f"sqrt(avg((y_true - {p}) ** 2)) AS rmse", f"avg(abs(y_true - {p})) AS mae")
        + " FROM te"
        for m, p in _TEST_MEMBERS.items()
    ),
)
def validated_blend(spark, sf_dir):
    """Weights chosen on the validation rows, applied to and scored on the test rows."""
    weights = choose_weights(model_tables(spark, sf_dir, "val"))
    made = apply_weights(model_tables(spark, sf_dir, "test"), weights)
    return tidy(compare_members(made, MODELS))


@query(
    "stack_models",
    f"""
    WITH {_FC}
    SELECT 'day' AS model, count(*) AS n, {rounded('avg(day) AS mean_pred')} FROM fc WHERE day IS NOT NULL
    UNION ALL SELECT 'week', count(*), {rounded('avg(week) AS mean_pred')} FROM fc WHERE week IS NOT NULL
    UNION ALL SELECT 'mean', count(*), {rounded('avg(mean) AS mean_pred')} FROM fc WHERE mean IS NOT NULL""",
)
def stacked(spark, sf_dir):
    rows = stack_models(model_tables(spark, sf_dir))
    return tidy(
        rows.groupBy("model").agg(
            F.count(F.lit(1)).alias("n"), F.avg("y_pred").alias("mean_pred")
        )
    )


# --- minima over the whole simplex ------------------------------------------

PAIR = ("day", "mean")


@query(
    "optimal_weights",
    f"""
    WITH {_FC}, e AS (
      SELECT horizon_h, count(*) AS n, avg((y_true - day) ** 2) AS a, avg((y_true - mean) ** 2) AS b,
             avg((y_true - day) * (y_true - mean)) AS c
      FROM fc WHERE day IS NOT NULL GROUP BY 1),
    w AS (SELECT *, CASE WHEN a - 2 * c + b > 0 THEN least(greatest((b - c) / (a - 2 * c + b), 0), 1) ELSE 1 END AS x FROM e)
    SELECT horizon_h, n, {rounded('x AS w_day', '1 - x AS w_mean', 'sqrt(x * x * a + 2 * x * (1 - x) * c + (1 - x) * (1 - x) * b) AS rmse')}
    FROM w""",
)
def best_pair(spark, sf_dir):
    """The pair of weights of least RMSE for each horizon, in closed form as SQL."""
    wide = align_forecasts(stack_models(model_tables(spark, sf_dir)), PAIR)
    return tidy(optimal_weights(wide, PAIR, by=["horizon_h"]).drop("gap"))


@query(
    "optimal_weights_mae",
    f"""
    WITH {_FC}, q AS (
      SELECT horizon_h, y_true, day, mean, CASE WHEN day <> mean THEN (y_true - mean) / (day - mean) END AS r, abs(day - mean) AS k
      FROM fc WHERE day IS NOT NULL),
    c AS (
      SELECT horizon_h, r, sum(k) OVER (PARTITION BY horizon_h ORDER BY r) AS upto, sum(k) OVER (PARTITION BY horizon_h) AS total
      FROM q WHERE r IS NOT NULL),
    x AS (SELECT horizon_h, least(greatest(min(r), 0), 1) AS x FROM c WHERE 2 * upto >= total GROUP BY 1)
    SELECT horizon_h, count(*) AS n, {rounded('avg(abs(y_true - x * day - (1 - x) * mean)) AS mae')}, true AS proven
    FROM q JOIN x USING (horizon_h) GROUP BY horizon_h""",
)
def best_pair_mae(spark, sf_dir):
    """Least MAE for each horizon: the weighted median of the weights that fit a row, as SQL."""
    wide = align_forecasts(stack_models(model_tables(spark, sf_dir)), PAIR)
    found = optimal_weights(wide, PAIR, "mae", by=["horizon_h"], tolerance=1e-8)
    return tidy(found.select("horizon_h", "n", "mae", (F.col("gap") <= 1e-6 * F.col("mae")).alias("proven")))


# --- six models, every subset ------------------------------------------------

SIX = ("day", "week", "mean", "two", "short", "long")
SIX_STEPS = 6
_SIX_METHODS = METHODS | {"two": Persistence(48), "short": RecentMean(6), "long": RecentMean(168)}
_SIX_SQL = f"""{_FC},
lm AS (
  SELECT series_id, time_idx,
         avg(pv) OVER (PARTITION BY series_id ORDER BY time_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS short,
         avg(pv) OVER (PARTITION BY series_id ORDER BY time_idx ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS long
  FROM r),
f6 AS (
  SELECT y_true, [day, week, mean, t.pv, short, long] AS p
  FROM fc JOIN lm USING (series_id, time_idx)
  LEFT JOIN r t ON t.series_id = fc.series_id AND t.time_idx = fc.time_idx + fc.horizon_h - 48),
u AS (SELECT unnest(generate_series(0, {SIX_STEPS - 1})) AS u),
pt AS (
  SELECT [a.u, b.u, c.u, d.u, e.u, {SIX_STEPS - 1} - a.u - b.u - c.u - d.u - e.u] AS k
  FROM u a, u b, u c, u d, u e WHERE a.u + b.u + c.u + d.u + e.u <= {SIX_STEPS - 1}),
pw AS (SELECT k, list_transform(k, lambda x: x / {SIX_STEPS - 1}.0::DOUBLE) AS w FROM pt),
sb AS (SELECT unnest(generate_series(1, 63)) AS need),
s6 AS (SELECT need FROM sb WHERE bit_count(need) >= 2),
hv AS (
  SELECT y_true, list_transform(p, lambda x: coalesce(x, 0)) AS p,
         list_sum([CASE WHEN p[i] IS NULL THEN 0 ELSE 1 << (i - 1) END for i in [1, 2, 3, 4, 5, 6]]) AS have
  FROM f6),
pp AS (
  SELECT have, k, any_value(w) AS w, count(*) AS n,
         sum(abs(y_true - (w[1] * p[1] + w[2] * p[2] + w[3] * p[3] + w[4] * p[4] + w[5] * p[5] + w[6] * p[6]))) AS s
  FROM hv CROSS JOIN pw GROUP BY have, k),
sc AS (
  SELECT need, w, sum(n) AS n, sum(s) / sum(n) AS mae
  FROM pp JOIN s6 ON CAST(have AS BIGINT) & need = need
    AND list_sum([CASE WHEN k[i] = 0 THEN 0 ELSE 1 << (i - 1) END for i in [1, 2, 3, 4, 5, 6]]) & ~need = 0
  GROUP BY need, w)"""
_SUBSET_NAME = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN need & {1 << i} > 0 THEN '{m}' END" for i, m in enumerate(SIX)
) + "], lambda x: x IS NOT NULL), '+')"


@query(
    "six_subsets_mae",
    f"""
    WITH {_SIX_SQL}
    SELECT {_SUBSET_NAME} AS subset, CAST(bit_count(need) AS BIGINT) AS num_models, CAST(n AS BIGINT) AS n,
           {rounded(*[f'w[{i + 1}] AS w_{m}' for i, m in enumerate(SIX)], 'mae')}
    FROM sc""",
)
def six_subsets_mae(spark, sf_dir):
    """57 subsets of six models at every grid point of theirs, by MAE, from one array of sums for each pattern."""
    wide = long_forecasts(raw(spark, sf_dir), BLEND_HORIZON, _SIX_METHODS)
    outer = wide.withColumnsRenamed({m: f"pred_{m}" for m in SIX})
    return tidy(score_subsets(outer, SIX, steps=SIX_STEPS, metric="mae").drop("subset_no"))
