"""Hard negatives against plain loops over all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helio_spark.llm import hard_negatives as hn

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, every, positives=5, negatives=3):
    ok = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, a, c in (r for r in ok if r[0] % every == 0):
        score = sorted((-sum(x * y for x, y in zip(a, v)), j, d == c) for j, v, d in ok if j != i)
        for p, pid, _ in [s for s in score if s[2]][:positives]:
            fit = [s for s in score if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(i, pid, k + 1, j, -p, -n) for k, (n, j, _) in enumerate(fit)]
    return sorted(out)


def clustered(seed, n, width=12, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    return [(i, [x + rng.gauss(0, 0.6) for x in centres[c]], c) for i in range(n) for c in [rng.randrange(labels)]]


@pytest.mark.parametrize("block", [3, 4096])
def test_all_pairs(spark, block):
    rows = clustered(1, 400)
    rows += [(400 + i, rows[7][1], rows[7][2] ^ (i % 2)) for i in range(60)]  # one common vector
    frame = spark.createDataFrame(rows, VECTORS)
    got = hn.mine_hard_negatives(frame, F.col("vec_id") % 20 == 0, block=block, rows_at_once=16)
    want = brute(rows, 20)
    assert len(want) > 100
    assert sorted(map(tuple, got.collect())) == want


def test_odd_rows_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.8, 1.5], 2), (2, [0.8, 1.5], 2), (3, [0.9], 2), (4, [], 3),
        (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (8, None, 2), (9, [1.0, 1.5], None), (None, [1.0, 1.6], 2),
        (20, [0.0, 0.0], 1), (40, [-1.0, -2.0], 1), (41, [0.7, 1.4], 5), (42, [0.7, 1.4], 5), (43, [1.0, 1.0], None),
    ]
    frame = spark.createDataFrame(rows, VECTORS)
    for c in ("id", "v", "norm", "angles", "list", "score", "rank"):
        frame = frame.withColumn(c, F.lit("x"))
    got = hn.mine_hard_negatives(frame, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)


def test_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hn.mine_hard_negatives(none, F.col("vec_id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1)], VECTORS)
    assert hn.mine_hard_negatives(alone, F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    v = np.floor(np.concatenate([rng.normal(c, 20, (300, 16)) for c in (-150, 0, 150)]))
    v[5] = 0
    unit = np.stack([x / np.linalg.norm(x) for x in rng.normal(0, 1, (hn.REFERENCES, 16)) + np.repeat([[1.0], [-1.0]], 8, 0)])
    rows = object.__new__(hn.Vectors)
    rows.v, rows.norm = v, np.linalg.norm(v, axis=1)
    rows.id = rows.label = np.arange(len(v))
    rows.angles = hn.angles_to(unit, v, rows.norm)
    least, most = hn.score_bounds(rows, rows)
    exact = v @ v.T
    assert (least <= exact).all() and (exact <= most).all()
    assert (most < 0.5 * exact.max()).mean() > 0.3  # opposite clusters are told apart without scoring


def test_large_components_are_exact():
    rows = object.__new__(hn.Vectors)
    rows.v = np.array([[2.0**28 + 1, 2.0**28 - 1], [2.0**28 + 3, 2.0**27 + 1]])
    rows.norm = np.linalg.norm(rows.v, axis=1)
    i, j, score = hn.integer_scores(rows, rows, np.ones((2, 2), bool))
    ints = [[int(x) for x in r] for r in rows.v]
    assert score.tolist() == [sum(x * y for x, y in zip(ints[a], ints[b])) for a, b in zip(i, j)]
    rows.norm = rows.norm * 2**10
    with pytest.raises(ValueError, match="64 bits"):
        hn.integer_scores(rows, rows, np.ones((2, 2), bool))
