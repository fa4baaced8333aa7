from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from helio_spark.operators.blending import (
    best_subset,
    best_weights,
    blend,
    blend_stacked,
    explode_weight_grid,
    score_random_weights,
    score_subsets,
    score_weight_grid,
    subsets,
)
from helio_spark.operators.forecasts import KEYS, align_forecasts, stack_models, with_fallback
from helio_spark.plans.evaluation import apply_weights, choose_weights, compare_members

MODELS = ("p", "q", "r")


@pytest.fixture(scope="module")
def outer(spark):
    rng = np.random.default_rng(7)
    y = rng.random(300)
    rows = []
    for v in y:
        preds = [float(v + rng.normal(0.1 * k, 0.2 + 0.1 * k)) if rng.random() > 0.15 else None for k in range(3)]
        rows.append((float(v), *preds))
    data = spark.createDataFrame(rows, "y_true double, pred_p double, pred_q double, pred_r double").persist()
    return data, np.array(rows, dtype=float)


def _brute(data, members, weights, metric):
    cols = [1 + MODELS.index(m) for m in members]
    rows = data[~np.isnan(data[:, cols]).any(axis=1)]
    e = rows[:, 0] - rows[:, cols] @ np.array(weights)
    return float(np.sqrt((e**2).mean()) if metric == "rmse" else np.abs(e).mean())


@pytest.mark.parametrize("steps,counts", [(11, (1, 11, 66)), (5, (1, 5, 15))])
def test_size_of_the_simplex(spark, steps, counts):
    got = tuple(explode_weight_grid(spark.range(1), MODELS[:k], steps).count() for k in (1, 2, 3))
    assert got == counts


@pytest.mark.parametrize("metric", ["rmse", "mae"])
def test_grid_and_subsets_by_brute_force(outer, metric):
    df, data = outer
    want = {}
    for k in (2, 3):
        for members in combinations(MODELS, k):
            for w in product(range(6), repeat=k):
                if sum(w) == 5:
                    full = dict.fromkeys(MODELS, 0.0) | {m: x / 5 for m, x in zip(members, w)}
                    want["+".join(members), tuple(full.values())] = _brute(data, members, [x / 5 for x in w], metric)
    scored = score_subsets(df, MODELS, steps=6, metric=metric)
    got = {(r.subset, (r.w_p, r.w_q, r.w_r)): r[metric] for r in scored.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-10) for k in want)
    best = best_subset(scored, MODELS, metric).first()
    assert best[metric] == pytest.approx(min(want.values()), rel=1e-10)

    full = df.na.drop()
    whole = {(r.w_p, r.w_q, r.w_r): r[metric] for r in score_weight_grid(full, MODELS, 6, metric).collect()}
    assert all(v == pytest.approx(want["p+q+r", w], rel=1e-10) for w, v in whole.items()) and len(whole) == 21


def test_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0), (0.0, 1.0, 1.0)], "y_true double, pred_p double, pred_q double")
    best = best_weights(score_weight_grid(df, ["p", "q"]), ["p", "q"]).first()
    assert (best.w_p, best.w_q, best.rmse) == (0.0, 1.0, pytest.approx(1.0))
    assert subsets(["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]


def test_random_weights_are_a_repeatable_simplex(outer):
    df, data = outer
    full = df.na.drop()
    once = score_random_weights(full, MODELS, 40).collect()
    again = score_random_weights(full.repartition(7), MODELS, 40).collect()
    weights = lambda rows: sorted((r.trial, r.w_p, r.w_q, r.w_r) for r in rows)
    assert weights(once) == weights(again) and len(once) == 40
    assert all(min(r.w_p, r.w_q, r.w_r) >= 0 and r.w_p + r.w_q + r.w_r == pytest.approx(1) for r in once)
    r = once[0]
    assert r.rmse == pytest.approx(_brute(data, MODELS, [r.w_p, r.w_q, r.w_r], "rmse"))


def test_blend_checks_weights_and_members(outer):
    df, _ = outer
    same = blend(df, {"p": 1.0}).select(F.max(F.abs(F.col("y_pred") - F.col("pred_p")))).first()[0]
    assert same == 0.0
    with pytest.raises(ValueError, match="sum to"):
        blend(df, {"p": 0.5, "q": 0.4})
    with pytest.raises(ValueError, match="no forecasts of"):
        blend(df, {"p": 0.5, "x": 0.5})


def _tables(spark):
    schema = "series_id string, origin_ts timestamp, horizon_h int, y_true double, y_pred double"
    import datetime as dt

    def table(values):
        return spark.createDataFrame(
            [("a", dt.datetime(2024, 1, 1, h), 1, float(h), v) for h, v in values.items()], schema
        )

    return {"p": table({0: 0.5, 1: 1.5, 2: 2.5}), "q": table({1: 0.5, 2: 1.5, 3: 9.0})}


def test_alignment_and_fallback(spark):
    tables = _tables(spark)
    inner = align_forecasts(stack_models(tables), ["p", "q"])
    assert inner.count() == 2
    outer = align_forecasts(stack_models(tables), ["p", "q"], complete=False)
    assert outer.count() == 4 and outer.where("y_true is null").count() == 0
    rows = with_fallback(tables["p"], tables["q"], 0.5).orderBy("origin_ts").collect()
    assert [r.y_pred_ensemble for r in rows] == [0.5, 1.0, 2.0]


def test_stacked_blend_refuses_a_missing_member(spark):
    weights = spark.createDataFrame([("p", 0.5), ("q", 0.5)], "model string, weight double")
    with pytest.raises(Exception, match="lacks a weighted model"):
        blend_stacked(stack_models(_tables(spark)), weights, KEYS).collect()


@pytest.mark.parametrize("method", ["grid", "exhaustive", "random", "optimal"])
def test_choose_and_apply(spark, method):
    tables = _tables(spark)
    weights = choose_weights(tables, method)
    assert sum(weights.values()) == pytest.approx(1)
    made = apply_weights(tables, weights)
    rows = {r.model: r for r in compare_members(made, list(weights)).collect()}
    assert set(rows) == {"p", "q", "ensemble"}
    if method != "random":
        assert weights == pytest.approx({"p": 0.5, "q": 0.5}) and rows["ensemble"].rmse == pytest.approx(0)
