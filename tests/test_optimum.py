"""Optimal blend weights against fine grids, optimality conditions and closed forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helio_spark.operators.blending import score_weight_grid, simplex_points
from helio_spark.operators.optimum import least_norm, lowest_of_planes, optimal_weights

MODELS = ("p", "q.r", "s", "t")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    out = []
    for i in range(600):
        y = rng.random()
        noise = rng.normal([0.05, -0.1, 0.2, 0.0], [0.2, 0.25, 0.3, 0.6])
        out.append((int(i % 3), float(y), *[float(y + e) for e in noise]))
    out += [(0, None, 1.0, 1.0, 1.0, 1.0), (1, 0.5, None, 0.5, 0.5, 0.5), (7, None, 1.0, 1.0, 1.0, 1.0)]
    kinds = "h int, y_true double, " + ", ".join(f"`pred_{m}` double" for m in MODELS)
    return spark.createDataFrame(out, kinds).repartition(4).persist(), out


def brute(out, h, points, metric):
    data = np.array([r[1:] for r in out if r[0] == h and None not in r], float)
    e = data[:, :1] - data[:, 1:] @ points.T
    return len(data), np.sqrt((e**2).mean(axis=0)) if metric == "rmse" else np.abs(e).mean(axis=0)


@pytest.mark.parametrize("metric", ["rmse", "mae"])
def test_no_grid_point_is_better(rows, metric):
    df, out = rows
    got = {r.h: r for r in optimal_weights(df, MODELS, metric, by=["h"], tolerance=1e-9).collect()}
    assert set(got) == {0, 1, 2}
    for h, r in got.items():
        w = np.array([[r[f"w_{m}"] for m in MODELS]])
        n, own = brute(out, h, w, metric)
        _, grid = brute(out, h, simplex_points(4, 31), metric)
        assert (w >= 0).all() and w.sum() == pytest.approx(1) and r.n == n
        assert r[metric] == pytest.approx(own[0], abs=1e-12) and 0 <= r.gap <= 1e-7
        assert own[0] <= grid.min() + 1e-12
        assert own[0] >= grid.min() - 0.01
    whole = optimal_weights(df, MODELS, metric).first()
    assert whole.n == 600


def test_least_norm_meets_its_conditions():
    rng = np.random.default_rng(5)
    for k in range(1, 8):
        for rank in (k, max(1, k // 2)):
            a = rng.normal(size=(rank, k)) + rng.normal(size=(rank, 1))
            e = a.T @ a
            w = least_norm(e)
            slope = e @ w
            assert (w >= 0).all() and w.sum() == pytest.approx(1)
            assert slope.min() >= w @ slope - 1e-9 * np.abs(e).max()


def test_lowest_of_planes_by_grid():
    rng = np.random.default_rng(6)
    for k in (1, 2, 3):
        for _ in range(20):
            planes = rng.normal(size=(rng.integers(1, 30), k))
            w, value = lowest_of_planes(planes)
            points = simplex_points(k, 201)
            assert w.sum() == pytest.approx(1) and (w >= 0).all()
            assert value == pytest.approx((planes @ w).max(), abs=1e-9)
            assert value <= (points @ planes.T).max(axis=1).min() + 1e-9


def test_edges(spark, rows):
    df, _ = rows
    none = df.limit(0)
    for metric in ("rmse", "mae"):
        assert optimal_weights(none, MODELS, metric, by=["h"]).count() == 0
        assert optimal_weights(none, MODELS, metric).count() == 0
        same = df.where("h = 0").withColumn("pred_s", F.col("pred_p"))
        tie = optimal_weights(same, ["p", "s"], metric).first()
        assert tie.w_p + tie.w_s == pytest.approx(1)
        alone = optimal_weights(df, ["p"], metric).first()
        assert alone.w_p == 1.0 and alone.gap <= 1e-9
    with pytest.raises(ValueError):
        optimal_weights(df, MODELS, "mape")


def test_grid_sums_by_group_and_quoted_names(rows):
    df, out = rows
    got = score_weight_grid(df, MODELS, 5, "mae", by=["h"]).collect()
    points = simplex_points(4, 5)
    for h in range(3):
        n, grid = brute(out, h, points, "mae")
        mine = {tuple(r[f"w_{m}"] for m in MODELS): (r.n, r.mae) for r in got if r.h == h}
        assert len(mine) == len(points)
        for w, g in zip(points, grid):
            assert mine[tuple(w)] == (n, pytest.approx(g))
