"""Boosted trees against a plain implementation that splits one leaf at a time."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from helio_spark.operators.ordering import IDX, SERIES, TS
from helio_spark.plans import boosting
from helio_spark.plans.boosting import Spec, boosted_importance, fit_boosted, horizon_specs, predict_boosted, splits_table

NAN = float("nan")


def sample(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), rng.choice([1.0, 2.0, 3.0, None]), rng.gauss(0, 1)
        y = (2.0 if a > 0.6 else 0.5) + (b or 0) * 0.3 + 0.1 * c
        rows.append((f"s{i % 3}", i, a, b, NAN if i % 17 == 0 else c, y, None if i % 11 == 0 else y * a, float(1 + i % 2), i * 4 // n))
    return rows


SCHEMA = "series_id string, time_idx long, a double, b double, c double, t1 double, t2 double, w double, segment int"
FEATURES = ["a", "b", "c"]


def plain(rows, target, spec, bins):
    """(start, [(splits, leaf means by row)], losses) with loops; predictions of all rows."""
    train0 = [r for r in rows if r[8] == 0]
    borders = []
    for f in (2, 3, 4):
        values = sorted(r[f] for r in train0 if r[f] is not None and not math.isnan(r[f]))
        borders.append(sorted({values[math.ceil(i * len(values) / bins) - 1] for i in range(1, bins)}))
    code = [
        [0 if r[f] is None or math.isnan(r[f]) else 1 + sum(e < r[f] for e in border) for f, border in zip((2, 3, 4), borders)]
        for r in rows
    ]
    train = [i for i, r in enumerate(rows) if r[8] < spec.fold and r[target] is not None]
    val = [i for i, r in enumerate(rows) if r[8] == spec.fold and r[target] is not None]
    weight = sum(rows[i][7] for i in train)
    start = sum(rows[i][7] * rows[i][target] for i in train) / weight
    score = [start] * len(rows)
    loss = lambda: sum((score[i] - rows[i][target]) ** 2 for i in val) / len(val)
    trees, losses = [], [loss()]

    def best(leaf):
        stat = lambda part: (sum(rows[i][7] * (score[i] - rows[i][target]) for i in part), sum(rows[i][7] for i in part))
        g, h = stat(leaf)
        found = (0.0, 0, 0)
        for f in range(3):
            for c in range(bins + 1):
                left = [i for i in leaf if code[i][f] <= c]
                right = [i for i in leaf if code[i][f] > c]
                if min(len(left), len(right)) >= spec.min_rows:
                    (gl, hl), (gr, hr) = stat(left), stat(right)
                    gain = gl * gl / hl + gr * gr / hr - g * g / h
                    if gain > found[0] * (1 + 1e-8):
                        found = (gain, f, c)
        return found

    while len(trees) < spec.trees:
        leaves, splits = [(best(train), train, list(range(len(rows))))], []
        while len(leaves) < spec.leaves:
            (gain, f, c), leaf, every = max(leaves, key=lambda x: x[0][0])
            if gain <= 0:
                break
            leaves = [x for x in leaves if x[1] is not leaf]
            splits.append((FEATURES[f], borders[f][c - 1] if c else None, gain))
            for side in (True, False):
                part = [i for i in leaf if (code[i][f] <= c) is side]
                leaves.append((best(part), part, [i for i in every if (code[i][f] <= c) is side]))
        if not splits:
            break
        for _, leaf, every in leaves:
            value = -sum(rows[i][7] * (score[i] - rows[i][target]) for i in leaf) / sum(rows[i][7] for i in leaf)
            for i in every:
                score[i] += spec.rate * value
        trees.append(splits)
        losses.append(loss())
        if len(trees) - losses.index(min(losses[1:]), 1) >= spec.patience:
            break
    return start, trees, losses, score


SPECS = [
    Spec(0, trees=11, leaves=5, rate=0.5, min_rows=5),
    Spec(1, trees=3, leaves=9, rate=1.0, min_rows=10),
    Spec(0, fold=2, trees=4, leaves=4, rate=0.3, patience=1),
    Spec(1, fold=3, trees=30, leaves=3, rate=1.0, patience=2, min_rows=3),
]


@pytest.mark.parametrize("slots", [200, 2_000_000])
def test_trees_equal_plain_growth(spark, slots, monkeypatch):
    monkeypatch.setattr(boosting, "SLOTS", slots)
    rows = sample(300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = fit_boosted(df, FEATURES, ["t1", "t2"], SPECS, F.col("segment"), F.col("w"), bins=16)
    splits = splits_table(spark, got).collect()
    for k, (spec, model) in enumerate(zip(SPECS, got.models)):
        start, trees, losses, _ = plain(rows, 5 + spec.target, spec, 16)
        assert model.start == pytest.approx(start)
        assert model.losses == pytest.approx(losses[: len(model.losses)], rel=1e-6)
        assert len(model.losses) == len(losses)
        kept = losses.index(min(losses[1:]), 1)
        assert len(model.trees) == kept
        mine = {}
        for s in sorted((s for s in splits if s.model == k), key=lambda s: (s.tree, s.node)):
            mine.setdefault(s.tree, []).append((s.feature, s.threshold, round(s.gain, 5)))
        for t in range(kept):
            assert sorted(mine[t], key=str) == sorted([(f, x, round(g, 5)) for f, x, g in trees[t]], key=str)


def test_forecasts_and_importance(spark):
    rows = sample(300)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("time_idx") * 3600))
    df = df.withColumns({"target_h1": F.col("t1"), "target_h2": F.col("t2")})
    specs = [Spec(0, trees=4, leaves=4, rate=0.5), Spec(1, trees=4, leaves=4, rate=0.5)]
    got = fit_boosted(df, FEATURES, ["t1", "t2"], specs, F.col("segment"), bins=16)
    long = predict_boosted(df, got, {0: 1, 1: 2}, keep=["segment"]).collect()
    assert len(long) == 600
    by = {(r[SERIES], r[IDX], r.horizon_h): r for r in long}
    rows = [(*r[:7], 1.0, r[8]) for r in rows]
    for k, h in ((0, 1), (1, 2)):
        assert len(got.models[k].trees) == 4
        score = plain(rows, 5 + k, specs[k], 16)[3]
        for r, p in zip(rows, score):
            line = by[r[0], r[1], h]
            assert line.y_pred == pytest.approx(p, abs=1e-7) and line.y_true == r[5 + k] and line.segment == r[8]
            assert (line.forecast_ts - line.origin_ts).total_seconds() == 3600 * h
    table = boosted_importance(spark, got).collect()
    assert {r.feature for r in table} == set(FEATURES)
    assert sum(r.splits for r in table) * 2 == sum(f >= 0 for m in got.models for t in m.trees for f in t.feature)


def test_same_trees_for_any_partitions(spark):
    df = spark.createDataFrame(sample(400, 3), SCHEMA)
    fit = lambda d: fit_boosted(d, FEATURES, ["t1"], SPECS[:1], F.col("segment"), F.col("w"), bins=32)
    one, other = fit(df.coalesce(1)), fit(df.repartition(13))
    assert one.models == other.models


def test_odd_tables(spark):
    df = spark.createDataFrame(sample(40), SCHEMA)
    for frame in (df.limit(0), df.where("segment > 0"), df.withColumn("t1", F.lit(None).cast("double"))):
        got = fit_boosted(frame, FEATURES, ["t1"], [Spec(0, trees=3)], F.col("segment"))
        assert got.models[0].trees == [] and math.isnan(got.models[0].start)
        placed = df.withColumn("ts", F.timestamp_seconds("time_idx"))
        assert predict_boosted(placed, got, {0: 1}).count() == 0
    alone = fit_boosted(df, ["a"], ["t1"], [Spec(0, trees=2, leaves=2, min_rows=1, rate=1.0)], F.lit(0))
    assert len(alone.models[0].trees) == 2  # nothing to stop by
    for bad in (dict(rate=0.0), dict(leaves=1), dict(feature_share=0.0)):
        with pytest.raises(ValueError):
            Spec(0, **bad)
    with pytest.raises(ValueError):
        fit_boosted(df, FEATURES, ["t1"], horizon_specs(2), F.col("segment"))


def test_scores_are_not_stored_before_trees_are_added_to_them(spark, monkeypatch):
    """A pass over few trees reads the narrow rows: no number for each model and row."""
    stored = []
    real = boosting.materialize
    monkeypatch.setattr(boosting, "materialize", lambda df, label: stored.append((label, dict(df.dtypes))) or real(df, label))
    df = spark.createDataFrame(sample(200), SCHEMA)
    fit_boosted(df, FEATURES, ["t1"], [Spec(0, trees=boosting.PENDING, leaves=3, rate=0.5, min_rows=5)], F.col("segment"), bins=8)
    assert [label for label, _ in stored] == ["binned"]
    assert stored[0][1]["codes"] == stored[0][1]["y"] == "binary"


@pytest.mark.parametrize("leaves", [1, 2, 16, 17, 70])
def test_leaves_are_those_of_a_walk(leaves):
    rng = random.Random(leaves)
    tree = boosting.Tree()
    while tree.feature.count(-1) < leaves:
        node = rng.choice([n for n, f in enumerate(tree.feature) if f < 0])
        tree.split(node, rng.randrange(3), rng.randrange(12))
    tree.value = [float(n) for n in range(len(tree.feature))]
    codes = [[rng.randrange(14) for _ in range(3)] for _ in range(500)]
    found = boosting._Leaves(tree).predict(boosting.np.array(codes, boosting.np.intp).T)
    for row, value in zip(codes, found):
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] if row[tree.feature[node]] <= tree.code[node] else tree.right[node]
        assert value == node


def test_trial_search_grows_until_early_stopping(spark, tmp_path, monkeypatch):
    """Four trees at most were grown of each model before, whatever early stopping would have said."""
    import datetime as dt
    from dataclasses import replace

    import numpy as np

    from helio_spark.catalog import QUERIES
    from helio_spark.plans import search

    rng, start = np.random.default_rng(5), dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=30 * i), i % 7, "click", float(50 + 40 * np.sin(i / 9) + rng.normal())) for i in range(420)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    grown, fit = [], search.fit_boosted

    def seen(df, features, targets, specs, segment):
        grown.extend(specs)
        # one horizon of each setting and a few trees, for the time of the test only
        few = [replace(s, trees=6) for s in specs if s.target == 0]
        fitted = fit(df, features, targets, few, segment)
        assert max(len(m.losses) - 1 for m in fitted.models) > 4
        return replace(fitted, models=[m for m in fitted.models for _ in targets])

    monkeypatch.setattr(search, "fit_boosted", seen)
    found = QUERIES["trial_search"](spark, str(tmp_path))
    default = Spec(target=0)
    assert len(grown) == 4 * 24 and {(s.trees, s.patience) for s in grown} == {(default.trees, default.patience)}
    assert found.count() == 4
