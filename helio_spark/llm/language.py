"""Language identification with error-correcting output codes.

Every language has a codeword of bits. One linear classifier for each bit, over
hashed n-grams of bytes, predicts it; decoding takes the codeword of least loss,
each bit weighted by how well its classifier fits, and flags close seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helio_spark.llm.examples import sampled
from helio_spark.llm.text import mixed, slices, utf8

#: Hashed n-gram features, examples in all, n-gram lengths in bytes.
FEATURES, EXAMPLES, LENGTHS = 1024, 8000, (1, 2, 3, 4)
#: Share by which the second codeword's loss must exceed the first's.
CLEAR = 0.25

_FOLD = np.full(256, 32, np.uint8)  # letters in lower case and non-ASCII bytes; all else is a space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def ngram_vectors(column: pa.Array, features: int = FEATURES) -> np.ndarray:
    """Unit vectors of square roots of hashed n-gram counts, one row for each text."""
    data, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, features), np.float32)
    for a, b in slices(offsets):
        at = offsets[a : b + 1] - offsets[a]
        code = _FOLD[data[offsets[a] : offsets[b]]].astype(np.uint64)
        doc = np.repeat(np.arange(b - a), np.diff(at))
        total = np.zeros((b - a) * features)
        value = np.zeros(len(code), np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            value = value[:m] << np.uint64(8) | code[n - 1 :]
            if n in LENGTHS:
                whole = doc[:m] == doc[n - 1 :]
                bucket = (mixed(value + (np.uint64(n) << np.uint64(40))) % np.uint64(features)).astype(np.int64)
                total += np.bincount((doc[:m] * features + bucket)[whole], minlength=len(total))
        out[a:b] = np.sqrt(total.reshape(b - a, features))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages; any two rows differ in many bits.

    All ways to split up to five languages in two; beyond that, the best of many
    random codes by least distance.
    """
    if n <= 5:
        bits = max(2 ** (n - 1) - 1, 1)
        code = np.array([[(b + 1) >> max(i - 1, 0) & 1 if i else 0 for b in range(bits)] for i in range(n)])
        return 2.0 * code - 1
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, width)) * 2.0 - 1
        code = code[:, (code.sum(0) < n) & (code.sum(0) > -n)]
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9
        if apart.min() > far:
            best, far = code, apart.min()
    return best


class Model:
    def __init__(self, x: np.ndarray, lang: np.ndarray, ridge: float = 1.0):
        self.languages = sorted(set(lang))
        row = np.searchsorted(self.languages, lang)
        self.code = codewords(len(self.languages))
        y = self.code[row]
        x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
        n_of = np.bincount(row)
        weight = (1.0 / n_of[row]) * len(row) / len(n_of)  # languages count alike
        left = x.T @ (x * weight[:, None]) + ridge * np.eye(x.shape[1])
        self.w = np.linalg.solve(left, x.T @ (y * weight[:, None]))
        loss = np.average(np.log1p(np.exp(-4 * y * (x @ self.w))), axis=0, weights=weight)
        self.trust = 1.0 / (loss + 0.05)
        self.trust /= self.trust.sum()

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each text against each codeword."""
        margin = x @ self.w[:-1].astype(np.float32) + self.w[-1].astype(np.float32)
        out = np.empty((len(x), len(self.code)))
        for i, word in enumerate(self.code):
            out[:, i] = np.log1p(np.exp(-4 * margin * word)) @ self.trust
        return out


def fit(docs: DataFrame, learn: Column, id_col="doc_id", text_col="text", lang_col="lang", bound=EXAMPLES) -> Model | None:
    """A model of about ``bound`` rows at most, as many of each language; None without any."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & learn).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    few = sampled(rows, F.col("id"), bound, by="lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = ngram_vectors(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes() for v in x], pa.binary()), batch.column(1)], ["x", "lang"]
            )

    got = few.select("text", "lang").mapInArrow(run, "x binary, lang string").toArrow()  # bounded
    if not len(got):
        return None
    x = np.stack([np.frombuffer(v, np.float32) for v in got.column("x").to_pylist()])
    lang = np.array(got.column("lang").to_pylist())
    order = np.lexsort((x @ np.arange(x.shape[1]), lang))  # sums don't depend on the order of tasks
    return Model(x[order], lang[order])


def predict_language(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", clear: float = CLEAR
) -> DataFrame:
    """id, lang_pred, score and ambiguous for each row; no shuffle.

    A null text and one without a letter is ``und`` with score 0, and so is every
    text if nothing was learned. Repeated rows are each predicted, equal losses go
    to the first language by name. The score is the share of exp(-8 x loss).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            known = np.array(batch.column(2).to_pylist(), bool) if model else np.zeros(n, bool)
            pred, score, close = np.full(n, "und", object), np.zeros(n), ~known
            if known.any():
                loss = model.losses(ngram_vectors(batch.column(1)))
                best = loss.argmin(1)
                share = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
                pred[known] = np.array(model.languages, object)[best[known]]
                score[known] = (1 / share.sum(1))[known]
                two = np.sort(loss, axis=1)[:, :2]
                close = close | (two[:, -1] < (1 + clear) * two[:, 0]) & (len(model.languages) > 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(close)],
                ["id", "lang_pred", "score", "ambiguous"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), has_letter.alias("letter")
    )
    return rows.mapInArrow(run, "id long, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)
