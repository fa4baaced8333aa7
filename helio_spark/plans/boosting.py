"""Leaf-wise boosted regression trees on histograms, many models in one scan.

Features are binned once and stored. A model is a target, a fold and settings
(``Spec``); all models grow their next tree side by side. One pass over the stored rows
gives the sums of gradient, weight and rows by (model, leaf, feature, bin) for every leaf
whose best split is not yet known: tasks sum in arrays, and only the sums are
shuffled. The driver holds the best split of each leaf, never rows.

Trees grow best first: the leaf with the greatest gain is split next, until there are
``leaves``. To know a leaf's gain before its turn, a pass looks at the children of all
leaves that could still be split, so a tree takes about as many passes as it is deep,
and is the same as with one pass for each split.

Sums are whole numbers (gradients in steps of a power of two), so trees do
not depend on the order in which tasks end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio_spark.functions.time import forecast_time
from helio_spark.operators.ordering import IDX, SERIES, TS
from helio_spark.session import materialize

#: Bins of a feature (a code fits a byte, 0 is a missing value) and how exact their borders are.
BINS, ACCURACY = 64, 20_000
#: Sums that one pass collects at most, rows summed at once, and trees applied anew in each pass.
SLOTS, ROWS, PENDING = 2_000_000, 16_384, 8
#: Bits of the greatest gradient.
BITS = 37
STORED, KINDS = ("y", "w", "segment", "last"), "y binary, w double, segment int, last int"
#: Place of the only bit of a word.
_PLACE = np.zeros(1 << 16, np.intp)
_PLACE[1 << np.arange(16)] = np.arange(16)


@dataclass(frozen=True)
class Spec:
    """One model. Rows with ``segment`` below ``fold`` train it, those equal to ``fold`` stop it."""

    target: int  #: place in the array of targets
    fold: int = 1
    trees: int = 1200
    leaves: int = 96
    rate: float = 0.02
    patience: int = 50
    min_rows: int = 20
    l2: float = 0.0
    feature_share: float = 1.0
    seed: int = 42

    def __post_init__(self):
        if self.trees < 1 or self.leaves < 2 or not 0 < self.rate <= 1 or self.patience < 1 or self.min_rows < 1:
            raise ValueError(f"impossible settings: {self}")
        if not 0 < self.feature_share <= 1 or self.l2 < 0 or self.fold < 1:
            raise ValueError(f"impossible settings: {self}")


@dataclass
class Tree:
    """Nodes from the root on; a leaf has no feature. Codes up to ``code`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    code: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, code: int) -> tuple[int, int]:
        self.feature[node], self.code[node] = feature, code
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for column, blank in ((self.feature, -1), (self.code, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            column += [blank, blank]
        return self.left[node], self.right[node]


class _Leaves:
    """Finds the leaves of many rows: each code allows a set of leaves, and the sets of a row's codes share one."""

    def __init__(self, tree: Tree):
        self.nodes, limits, todo = [], [], [(0, {})]
        while todo:
            node, within = todo.pop()
            feature, code = tree.feature[node], tree.code[node]
            if feature < 0:
                self.nodes.append(node)
                limits.append(within)
                continue
            low, high = within.get(feature, (0, 255))
            todo += [(tree.right[node], {**within, feature: (max(low, code + 1), high)}), (tree.left[node], {**within, feature: (low, min(high, code))})]
        self.value = np.array(tree.value)[self.nodes]
        self.words = -(-len(self.nodes) // 16)
        self.sets = {f: np.zeros((self.words, 256), np.uint16) for f in sorted({f for x in limits for f in x})}
        for place, within in enumerate(limits):
            for f, sets in self.sets.items():
                low, high = within.get(f, (0, 255))
                sets[place // 16, low : high + 1] |= np.uint16(1 << place % 16)

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Places in ``nodes``; ``codes`` (feature, row) are of the type of an index."""
        out = np.zeros(codes.shape[1], np.intp)
        for word in range(self.words if self.sets else 0):
            shared = None
            for f, sets in self.sets.items():
                own = sets[word].take(codes[f])
                shared = own if shared is None else np.bitwise_and(shared, own, out=shared)
            out += _PLACE.take(shared) if word == 0 else np.where(shared, _PLACE.take(shared) + 16 * word, 0)
        return out

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.value.take(self.place(codes))


@dataclass
class Model:
    """What ``fit_boosted`` gives for a spec: a start and trees whose values include the rate."""

    spec: Spec
    start: float  #: weighted mean of the targets, NaN without train rows
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  #: mean squared error of the fold's rows after 0, 1, .. trees


@dataclass
class Boosted:
    """Fitted models with the borders of the bins of each feature."""

    features: list[str]
    borders: list[list[float]]
    models: list[Model]


def bin_borders(train: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Values at the ranks ceil(i n / bins) of each feature; missing values don't count. One aggregate."""
    if not 2 <= bins <= 255:
        raise ValueError("a feature has 2 to 255 bins")
    ranks = [i / bins for i in range(1, bins)]
    clean = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in features]
    found = train.agg(*[F.percentile_approx(c, ranks, ACCURACY).alias(f"f{i}") for i, c in enumerate(clean)]).first()
    return [sorted(set(x or [])) for x in found]


def _doubles(features: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"_f{i}") for i, c in enumerate(features)]


def _codes(columns: Sequence[pa.Array], borders: Sequence[Sequence[float]]) -> np.ndarray:
    out = np.zeros((len(columns[0]) if columns else 0, len(borders)), np.uint8)
    for i, (column, border) in enumerate(zip(columns, borders)):
        x = column.to_numpy(zero_copy_only=False)
        out[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(np.array(border), x, "left"))
    return out


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    values = column.values.to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    at = column.offsets.to_numpy() if len(column) else np.zeros(1, np.int64)
    return values[at[0] : at[-1]].reshape(len(column), width).astype(kind, copy=False)


def _packed(rows: np.ndarray) -> pa.Array:
    """A row of numbers as one binary value."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _by_place(column: pa.Array, width: int, kind) -> np.ndarray:
    """What ``_packed`` packed, as (place, row)."""
    if not len(column):
        return np.zeros((width, 0), kind)
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first, last = ends[column.offset], ends[column.offset + len(column)]
    rows = np.frombuffer(column.buffers()[2], np.uint8)[first:last].view(kind).reshape(len(column), width)
    return np.ascontiguousarray(rows.T)


def binned_rows(
    df: DataFrame, features: Sequence[str], borders, targets: Sequence[str], segment: Column, last_fold: Column, weight: Column
) -> DataFrame:
    """(codes, y, w, segment, last): one byte for each feature, all targets as doubles in one value (NaN if missing)."""
    y = F.array(*[F.coalesce(F.col(f"`{t}`").cast("double"), F.lit(float("nan"))) for t in targets])
    rows = df.select(*_doubles(features), y.alias("y"), weight.cast("double").alias("w"), segment.cast("int").alias("segment"), last_fold.cast("int").alias("last"))
    n, width = len(features), len(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_packed(_codes(batch.columns[:n], borders)), _packed(_matrix(batch.column(n), width, np.float64))]
            yield pa.RecordBatch.from_arrays([*packed, *batch.columns[n + 1 :]], ["codes", *STORED])

    return rows.where("segment is not null").mapInArrow(run, f"codes binary, {KINDS}")


class _Growth:
    """The tree that a model grows, with what is known of its leaves."""

    def __init__(self, spec: Spec, features: int, number: int):
        self.spec, self.tree, self.known = spec, Tree(), {}
        rng = np.random.default_rng([spec.seed, spec.target, spec.fold, number])
        take = max(1, math.ceil(features * spec.feature_share))
        self.features = np.sort(rng.permutation(features)[:take])
        self.wanted = [0]

    def learn(self, node: int, sums: np.ndarray, unit: tuple[float, float]) -> None:
        """``sums``: (feature, bin, [gradient, weight, rows]) of a leaf."""
        total = sums[0].sum(axis=0)
        grad, weight, rows = total[0] * unit[0], total[1] * unit[1], int(total[2])
        left = np.cumsum(sums, axis=1)[:, :-1]
        right = total - left
        l2 = self.spec.l2
        with np.errstate(divide="ignore", invalid="ignore"):
            score = lambda x: (x[..., 0] * unit[0]) ** 2 / (x[..., 1] * unit[1] + l2)
            gain = score(left) + score(right) - grad**2 / (weight + l2)
        ok = (left[..., 2] >= self.spec.min_rows) & (right[..., 2] >= self.spec.min_rows) & (left[..., 1] > 0) & (right[..., 1] > 0)
        gain = np.where(ok, gain, 0.0)
        gain = np.where(gain > 0, gain, 0.0)[self.features]
        nice = np.array([float(f"{g:.9e}") for g in gain.max(axis=1)])  # equal gains tie despite rounding
        place = int(np.argmax(nice))
        own = gain[place]
        code = int(np.argmax(own >= own.max() * (1 - 1e-9))) if own.max() > 0 else 0
        value = -grad / (weight + l2) * self.spec.rate if weight + l2 > 0 else 0.0
        self.known[node] = (float(nice[place]), int(self.features[place]), code, value, rows)

    def grown(self) -> Tree | None:
        """The tree, or None if the children of ``wanted`` leaves must be looked at first."""
        done, leaves = Tree(), {0: 0}  # node here: node in self.tree
        best = lambda n: (-self.known[n][0], n)
        while len(leaves) < self.spec.leaves:
            open_ = sorted((n for n in leaves.values() if self.known[n][0] > 0), key=best)
            if not open_:
                break
            node = open_[0]
            if self.tree.feature[node] < 0 or self.tree.left[node] not in self.known:
                self.wanted = []
                for n in open_[: self.spec.leaves - len(leaves)]:
                    if self.tree.feature[n] < 0:
                        self.wanted += self.tree.split(n, *self.known[n][1:3])
                return None
            here = next(h for h, n in leaves.items() if n == node)
            gain, feature, code, _, _ = self.known[node]
            pair = done.split(here, feature, code)
            done.gain[here] = gain
            del leaves[here]
            leaves |= dict(zip(pair, (self.tree.left[node], self.tree.right[node])))
        for here, node in leaves.items():
            done.value[here] = self.known[node][3]
        return done


def _starts(rows: DataFrame, specs: Sequence[Spec], targets: int) -> tuple[list[float], float, float, int]:
    """Weighted mean of each spec's train rows; greatest target and weight; number of rows. One scan."""
    pairs = sorted({(s.target, s.fold) for s in specs})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, most, n = np.zeros((len(pairs), 2)), np.zeros(2), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y, w, segment, last = _by_place(batch.column(0), targets, np.float64), *(batch.column(i).to_numpy() for i in (1, 2, 3))
            known = ~np.isnan(y)
            y = np.where(known, y, 0.0)
            most = np.maximum(most, [np.abs(y).max(), w.max()])
            n += len(w)
            for fold in {f for _, f in pairs}:
                mine = np.where((segment < fold) & (last >= fold), w, 0.0)
                if mine.any():
                    found = {t: (y[t] @ mine, known[t] @ mine) for t, f in pairs if f == fold}
                    for k, (t, f) in enumerate(pairs):
                        if f == fold:
                            sums[k] += found[t]
        found = np.concatenate([sums, [most, [n, 0.0]]])
        place = np.r_[np.arange(len(pairs)), -1, -2]
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(found[:, 0]), pa.array(found[:, 1])], ["k", "a", "b"])

    each = rows.select(*STORED).mapInArrow(run, "k int, a double, b double").groupBy("k")
    found = {r.k: r for r in each.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("a").alias("x"), F.max("b").alias("z")).collect()}
    mean = {}
    for k, pair in enumerate(pairs):
        total, weight = (found[k].a, found[k].b) if found else (0.0, 0.0)
        mean[pair] = float(f"{total / weight:.10e}") if weight else math.nan
    most, heaviest, n = (found[-1].x, found[-1].z, found[-2].a) if found else (0.0, 0.0, 0)
    return [mean[s.target, s.fold] for s in specs], float(most), float(heaviest), int(n)


def fit_boosted(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    specs: Sequence[Spec],
    segment: Column,
    weight: Column | None = None,
    last_fold: Column | None = None,
    bins: int = BINS,
) -> Boosted:
    """Fit every spec on the rows of ``df``; passes over the rows do not grow with their number.

    ``segment`` is 0 for rows that every fold trains on, k for those that fold k
    is stopped by (and later folds train on), and null for rows that stay out; bins are
    borders of segment 0. Folds after a row's ``last_fold`` do without it. Rows without a target or weight don't count for it.
    A spec stops when ``patience`` trees gave no lower loss, and keeps the trees up to its
    lowest (one at least); without rows to stop by it grows all. A missing feature value goes left of
    every other. A spec without train rows gives a model that forecasts nothing.
    """
    features, targets, specs = list(features), list(targets), list(specs)
    if not features or not targets or not specs:
        raise ValueError("features, targets and specs must not be empty")
    if any(not 0 <= s.target < len(targets) for s in specs):
        raise ValueError("a spec has a target that is not there")
    borders = bin_borders(df.where(segment == 0), features, bins)
    last = F.lit(2**31 - 1) if last_fold is None else last_fold
    w = F.lit(1.0) if weight is None else F.coalesce(weight, F.lit(0.0))
    rows = materialize(binned_rows(df, features, borders, targets, segment, last, w), "binned")
    starts, most, heaviest, n = _starts(rows, specs, len(targets))
    models = [Model(s, a) for s, a in zip(specs, starts)]
    bits = min(BITS, 61 - max(1, n).bit_length())
    # a score lies within the targets or, for a time, a little beyond: two bits to spare
    most, heaviest = most or 1.0, heaviest or 1.0
    grain, weight_grain, loss_grain = (
        2.0 ** (bits - spare - math.frexp(bound)[1])
        for bound, spare in ((2 * most * heaviest, 3), (heaviest, 7), (4 * most * most, 3))
    )
    scored = rows  # with scores when the first trees have been added to them
    active, pending = list(range(len(specs))), [[] for _ in specs]
    depth, number = bins + 1, 0
    while active:
        growths = {i: _Growth(specs[i], len(features), number) for i in active}
        for i, g in growths.items():
            if number >= specs[i].trees:  # its last tree is there, only its loss is not known
                g.wanted = []
        losses = _pass(scored, specs, growths, starts, pending, len(features), depth, len(targets), (grain, weight_grain, loss_grain), True)
        for i in list(active):
            models[i].losses.append(losses[i])
            best = 1 + int(np.argmin(models[i].losses[1:])) if losses[i] is not None and number else number
            if number >= specs[i].trees or number - best >= specs[i].patience or growths[i].known[0][0] <= 0:
                active.remove(i)
                del growths[i]
                if losses[i] is not None:
                    del models[i].trees[best:]
        todo = dict(growths)
        while todo:
            for i, g in list(todo.items()):
                tree = g.grown()
                if tree is not None:
                    models[i].trees.append(tree)
                    pending[i].append(tree)
                    del todo[i]
            if todo:
                _pass(scored, specs, todo, starts, pending, len(features), depth, len(targets), (grain, weight_grain, loss_grain), False)
        number += 1
        if number % PENDING == 0 and any(number < specs[i].trees for i in active):
            scored = materialize(_rescored(scored, starts, pending, len(features)), "scored")
            pending = [[] for _ in specs]
    return Boosted(features, borders, models)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _scores(batch: pa.RecordBatch, starts: Sequence[float]) -> np.ndarray:
    """(model, row): the stored scores, or the starts where there are none yet."""
    if batch.num_columns > 5:
        return _by_place(batch.column(5), len(starts), np.float64)
    return np.broadcast_to(np.array(starts)[:, None], (len(starts), batch.num_rows))


def _rescored(scored: DataFrame, starts: Sequence[float], pending, features: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = [[_Leaves(tree) for tree in trees] for trees in pending]
        for batch in _slices(batches):
            codes = _by_place(batch.column(0), features, np.uint8).astype(np.intp)
            score = _scores(batch, starts).copy()
            for i, trees in enumerate(grown):
                for leaves in trees:
                    score[i] += leaves.predict(codes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], _packed(score.T)], ["codes", *STORED, "score"])

    return scored.mapInArrow(run, f"codes binary, {KINDS}, score binary")


def _pass(scored, specs, growths, starts, pending, features: int, depth: int, targets: int, grains, with_loss: bool) -> list:
    """Let the growths learn their wanted leaves; mean losses of all specs if asked for.

    Leaves are taken in turns of at most ``SLOTS`` sums, one scan each.
    """
    grain, weight_grain, loss_grain = grains
    wanted = [(i, node) for i, g in growths.items() for node in g.wanted]
    size, step = features * depth, max(1, SLOTS // (features * depth))
    losses = [None] * len(specs)
    for first in range(0, max(1, len(wanted)), step):
        mine = wanted[first : first + step]
        place = {}
        for k, (i, node) in enumerate(mine):
            place.setdefault(i, {})[node] = k
        plan = {i: (specs[i], growths[i].tree, nodes) for i, nodes in place.items()}
        loss_of = {i: specs[i] for i in growths} if with_loss and first == 0 else {}
        todo = scored.sparkSession.sparkContext.broadcast((plan, loss_of, {i: pending[i] for i in {*plan, *loss_of}}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plan, loss_of, pending = todo.value
            grown = {i: [_Leaves(tree) for tree in trees] for i, trees in pending.items()}
            growing = {}
            for i, (_, tree, nodes) in plan.items():
                leaves, first = _Leaves(tree), min(nodes.values())
                growing[i] = leaves, np.array([nodes.get(node, first - 1) - first for node in leaves.nodes]), first, len(nodes)
            sums = np.zeros((3, len(mine), features, depth), np.int64)
            loss = np.zeros((len(specs), 3), np.int64)
            for batch in _slices(batches):
                codes = _by_place(batch.column(0), features, np.uint8).astype(np.intp)
                y, score = _by_place(batch.column(1), targets, np.float64), _scores(batch, starts)
                w, segment, last = (batch.column(i).to_numpy() for i in (2, 3, 4))
                gaps, heavy = np.isnan(y).any(axis=1), np.rint(w * weight_grain)
                even = heavy.min() == heavy.max()
                folds = {}
                for fold in {specs[i].fold for i in grown}:
                    rows = np.flatnonzero((segment < fold) & (last >= fold) & (w > 0))
                    own = codes if len(rows) == len(w) else codes[:, rows]
                    folds[fold] = rows, own, np.flatnonzero(segment == fold)
                for i, trees in grown.items():
                    spec = specs[i]
                    rows, own, val = folds[spec.fold]
                    if math.isnan(starts[i]) or not (i in growing and len(rows) or i in loss_of and len(val)):
                        continue
                    now = score[i].copy()
                    for leaves in trees:
                        now += leaves.predict(codes)
                    error = now - y[spec.target]
                    if i in loss_of and len(val):
                        off = error[val]
                        off = off[~np.isnan(off)] if gaps[spec.target] else off
                        loss[i, 0] += int(np.rint(off**2 * loss_grain).sum())
                        loss[i, 2] += len(off)
                    if i not in growing or not len(rows):
                        continue
                    leaves, place, first, wide = growing[i]
                    k = place.take(leaves.place(own))
                    take = k >= 0
                    if gaps[spec.target]:
                        take &= ~np.isnan(error[rows])
                    if not take.all():
                        rows, own, k = rows[take], own[:, take], k[take]
                    each = heavy[rows]
                    grad = np.rint(w[rows] * error[rows] * grain)
                    k *= depth
                    for f in range(features):
                        slot = k + own[f]
                        count = np.bincount(slot, minlength=wide * depth)
                        total = count * int(heavy[0]) if even else np.bincount(slot, each, wide * depth)
                        for c, x in ((0, np.bincount(slot, grad, wide * depth)), (1, total), (2, count)):
                            sums[c, first : first + wide, f] += x.astype(np.int64, copy=False).reshape(wide, depth)
            sums = sums.reshape(3, -1)
            at = np.flatnonzero(sums[2])
            lost = np.flatnonzero(loss[:, 2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([at, -1 - lost])), *[pa.array(np.concatenate([sums[c, at], loss[lost, c]])) for c in range(3)]],
                ["slot", "g", "h", "n"],
            )

        found = (
            scored.mapInArrow(run, "slot long, g long, h long, n long")
            .groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
        )
        slot, *columns = (found.column(c).to_numpy() for c in ("slot", "g", "h", "n"))
        values = np.stack(columns, axis=1) if len(slot) else np.zeros((0, 3), np.int64)
        sums = np.zeros((len(mine) * size, 3), np.int64)
        sums[slot[slot >= 0]] = values[slot >= 0]
        for k, (i, node) in enumerate(mine):
            growths[i].learn(node, sums[k * size : (k + 1) * size].reshape(features, depth, 3), (1 / grain, 1 / weight_grain))
        for s, (total, _, rows) in zip(slot[slot < 0], values[slot < 0]):
            losses[-1 - s] = total / loss_grain / rows
        todo.destroy()
    return losses


def predict_boosted(
    df: DataFrame,
    boosted: Boosted,
    horizons: Mapping[int, int],
    keep: Sequence[str] = (),
    truths: bool = True,
    fold: str | None = None,
    ahead: Sequence[str] = (),
) -> DataFrame:
    """Long forecasts, a row for each origin and model; one pass over the rows.

    ``horizons``: horizon of each model to use, by its place, which comes as ``model``. With
    ``fold``, a column, a row is forecast by the models of that fold only. ``y_true`` is
    ``target_h{h}`` where ``df`` has it and ``truths`` is set, else null; for a name in
    ``ahead`` the column ``{name}_h{h}`` of the horizon comes as ``name``. Models without train rows give no rows.
    """
    borders, used = boosted.borders, list(horizons)
    shared = df.sparkSession.sparkContext.broadcast([boosted.models[i] for i in used])
    columns, per = [SERIES, IDX, TS, *keep], ["target", *ahead]
    every = sorted(set(horizons.values()))
    place = np.array([every.index(horizons[i]) if i in horizons else -1 for i in range(len(boosted.models))])

    def at_horizons(name: str) -> Column:
        known = [F.col(f"{name}_h{h}") if f"{name}_h{h}" in df.columns and (truths or name != "target") else F.lit(None) for h in every]
        return F.array(*[c.cast("double") for c in known])

    rows = df.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)], *[at_horizons(c).alias(f"_y{i}") for i, c in enumerate(per)],
        (F.lit(0) if fold is None else F.col(fold).cast("int")).alias("_fold"), *_doubles(boosted.features),
    )
    first = len(columns) + len(per) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [(i, m.start, m.spec.fold, [_Leaves(tree) for tree in m.trees]) for i, m in zip(used, shared.value) if not math.isnan(m.start)]
        for batch in batches:
            codes = np.ascontiguousarray(_codes(batch.columns[first:], borders).T).astype(np.intp)
            n = codes.shape[1]
            folds = batch.column(first - 1).fill_null(-1).to_numpy()
            at, model, pred = [np.zeros(0, np.intp)], [np.zeros(0, np.int32)], [np.zeros(0)]
            rows_of = {f: np.arange(n) if fold is None else np.flatnonzero(folds == f) for f in {f for _, _, f, _ in models}}
            codes_of = {f: codes if len(rows) == n else codes[:, rows] for f, rows in rows_of.items()}
            for i, start, f, trees in models:
                out = np.full(len(rows_of[f]), start)
                for leaves in trees if len(out) else ():
                    out += leaves.predict(codes_of[f])
                at.append(rows_of[f])
                model.append(np.full(len(out), i, np.int32))
                pred.append(out)
            at = np.concatenate(at)
            order = np.argsort(at, kind="stable")
            at, model, pred = at[order], np.concatenate(model)[order], np.concatenate(pred)[order]
            edge = pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32())
            own = pa.array(at * len(every) + place[model])
            lists = [pa.ListArray.from_arrays(edge, x) for x in (pa.array(model), pa.array(pred), *[c.flatten().take(own) for c in batch.columns[len(columns) : first - 1]])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *lists], names)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(columns)]]
    lists = ["_m", "_p", *[f"_y{i}" for i in range(len(per))]]
    names = [f"_k{i}" for i in range(len(columns))] + lists
    scored = rows.mapInArrow(run, ", ".join([*kinds, "_m array<int>", *[f"{c} array<double>" for c in lists[1:]]]))
    hours = F.array(*[F.lit(horizons.get(i)).cast("int") for i in range(len(boosted.models))])
    back = [F.col(f"_k{i}").alias(c) for i, c in enumerate(columns)]
    long = scored.select(*back, F.inline(F.arrays_zip(*lists))).withColumn("horizon_h", F.get(hours, F.col("_m")))
    return long.select(
        SERIES, IDX, F.col(TS).alias("origin_ts"), forecast_time(F.col(TS), F.col("horizon_h")).alias("forecast_ts"),
        "horizon_h", *keep, *[F.col(f"_y{i}").alias(c) for i, c in enumerate(per) if i], F.col("_m").alias("model"),
        F.col("_y0").alias("y_true"), F.col("_p").alias("y_pred"),
    )


def splits_table(spark, boosted: Boosted) -> DataFrame:
    """model, tree, node, feature, threshold, gain of every split; values up to the threshold go left.

    A null threshold divides missing values from all others.
    """
    rows = [
        (i, t, node, boosted.features[f], boosted.borders[f][tree.code[node] - 1] if tree.code[node] else None, tree.gain[node])
        for i, m in enumerate(boosted.models)
        for t, tree in enumerate(m.trees)
        for node, f in enumerate(tree.feature)
        if f >= 0
    ]
    return spark.createDataFrame(rows, "model int, tree int, node int, feature string, threshold double, gain double")


def boosted_importance(spark, boosted: Boosted, top: int | None = None) -> DataFrame:
    """feature, splits and gain averaged over the models; by splits, gain and name."""
    used = splits_table(spark, boosted).groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))
    names = spark.createDataFrame([(f,) for f in boosted.features], "feature string")
    n = float(len(boosted.models))
    out = names.join(used, "feature", "left").select(
        "feature", (F.coalesce("splits", F.lit(0)) / n).alias("splits"), (F.coalesce("gain", F.lit(0.0)) / n).alias("gain")
    )
    ordered = out.orderBy(F.desc("splits"), F.desc("gain"), "feature")
    return ordered if top is None else ordered.limit(top)


def horizon_specs(horizon: int, folds: Sequence[int] = (1,), **settings) -> list[Spec]:
    """A spec for each fold and horizon 1 .. ``horizon``; targets are in order of the horizon."""
    return [Spec(target=h - 1, fold=f, **settings) for f in folds for h in range(1, horizon + 1)]


def varied(specs: Sequence[Spec], **settings) -> list[Spec]:
    return [replace(s, **settings) for s in specs]
