"""Quality by votes of the nearest labelled texts in a latent space.

A text is a histogram of hashed shape n-grams (letters, capitals and digits as
classes, other characters as they are) and of words that repeat at a short
distance, so that the language does not matter. The examples' weighted histograms
are reduced by a truncated singular value decomposition; every document meets
every example in one blocked product, and the nearest ones vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helio_spark.llm.text import WHITE, Words, mixed, slices, utf8

#: Hashed features, latent dimensions, neighbours that vote, labelled examples.
FEATURES, LATENT, NEIGHBOURS, EXAMPLES = 1024, 32, 25, 6000
#: Documents of one product with all examples.
BLOCK = 1024

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def shape_histograms(column: pa.Array, features: int = FEATURES) -> np.ndarray:
    """Shares of hashed shape n-grams (1 to 4 bytes) and of repeated words, one row for each text."""
    data, offsets = utf8(column)
    repeats = 4
    out = np.zeros((len(offsets) - 1, features), np.float32)
    for a, b in slices(offsets):
        at = offsets[a : b + 1] - offsets[a]
        raw = data[offsets[a] : offsets[b]]
        shape = _SHAPE[raw].astype(np.uint64)
        doc = np.repeat(np.arange(b - a), np.diff(at))
        size = features - repeats
        total = np.zeros((b - a) * size)
        value = np.zeros(len(shape), np.uint64)
        for n in range(1, 5):
            m = len(shape) - n + 1
            if m <= 0:
                break
            value = value[:m] << np.uint64(8) | shape[n - 1 :]
            whole = doc[:m] == doc[n - 1 :]
            bucket = (mixed(value + (np.uint64(n) << np.uint64(40))) % np.uint64(size)).astype(np.int64)
            total += np.bincount((doc[:m] * size + bucket)[whole], minlength=len(total))
        total = total.reshape(b - a, size)
        out[a:b, :size] = total / np.maximum(total.sum(1, keepdims=True), 1)
        words = Words(raw, at, WHITE)
        word_doc = np.repeat(np.arange(b - a), words.counts())
        have = np.maximum(words.counts(), 1)
        for k in range(1, repeats + 1):
            same = (words.hash[k:] == words.hash[:-k]) & (word_doc[k:] == word_doc[:-k])
            out[a:b, size + k - 1] = np.bincount(word_doc[k:][same], minlength=b - a) / have
    return np.sqrt(out)


class Voters:
    """Latent vectors of the examples and their labels."""

    def __init__(self, x: np.ndarray, label: np.ndarray, latent: int = LATENT, neighbours: int = NEIGHBOURS):
        n = len(x)
        self.weight = np.log((1 + n) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        self.centre = (x * self.weight).mean(0)
        scaled = x  # in place: one copy of the examples on the driver
        scaled *= self.weight
        scaled -= self.centre
        _, _, axes = np.linalg.svd(scaled.T @ scaled, hermitian=True)
        self.axes = axes[:latent].T.astype(np.float32)
        self.label = label.astype(np.float32)
        self.vectors = self._unit(scaled @ self.axes)
        self.k = min(neighbours, n)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest examples, weighted by similarity."""
        out = np.empty(len(x))
        for i in range(0, len(x), BLOCK):
            y = self._unit((x[i : i + BLOCK] * self.weight - self.centre) @ self.axes)
            cosine = y @ self.vectors.T
            near = np.argpartition(-cosine, self.k - 1, axis=1)[:, : self.k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** 2
            out[i : i + BLOCK] = (weight * self.label[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def fit(examples: DataFrame, features: int = FEATURES) -> Voters | None:
    """Voters of stored (text, label) examples, which are bounded; None without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(i, BLOCK)
                x = shape_histograms(batch.column(0), features)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v.tobytes() for v in x], pa.binary()), batch.column(1), batch.column(2)], ["x", "label", "id"]
                )

    got = examples.select("text", "label", "id").mapInArrow(run, "x binary, label double, id long").toArrow()
    if not len(got):
        return None
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    label = got.column("label").to_numpy()[order]
    x = np.empty((len(order), features), np.float32)
    place = np.argsort(order)
    at = 0
    for chunk in got.column("x").chunks:
        for v in chunk:
            x[place[at]] = np.frombuffer(v.as_buffer(), np.float32)
            at += 1
    del got
    return Voters(x, label)


def score_quality(docs: DataFrame, voters: Voters | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1; all other columns as they are, no shuffle.

    A null text scores as an empty one; repeated rows score alike; without any
    example every score is 0.5. What is broadcast is bounded by the number of
    examples (128 bytes each) and the number of features.
    """
    if name in docs.columns:
        raise ValueError(f"docs already has a column {name}")
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            for i in range(0, batch.num_rows if voters else 0, BLOCK):  # histograms of a block only are held
                score[i : i + BLOCK] = voters.scores(shape_histograms(batch.column(at).slice(i, BLOCK)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)
