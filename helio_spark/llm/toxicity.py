"""Toxicity by votes of the nearest labelled texts under TF-IDF cosine.

Terms are words and the openings of longer words; those that the examples tie to
the label (chi-squared) span the vectors. The examples lie in an inverted index
in blocks, each with the largest weight of every term. A text's upper bound for a
block is the sum of its weights times those maxima; blocks are searched by
falling bound until none can beat the worst neighbour found, so the neighbours
are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helio_spark.llm.text import _BASE, _BYTE_VALUES, _INVERSE, Words, byte_class, mixed, powers, slices, utf8

#: Labelled examples, terms at most, least chi-squared, neighbours that vote, examples in a block.
EXAMPLES, TERMS, LEAST, NEIGHBOURS, BLOCK = 8000, 512, 25.0, 15, 64
OPENINGS = (4, 5, 6, 7)
#: Votes that the rate of texts without a term has in every score: few or far neighbours prove little.
PRIOR = 3.0
_NO_LETTER = byte_class(bytes(b for b in range(128) if not chr(b).isalpha()))


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term hash, document, first and last byte of all words and openings of a slice."""
    total = np.zeros(len(words.data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[words.data] * powers(_BASE, len(words.data)), out=total[1:])
    back = powers(_INVERSE, len(words.data) + 1)
    doc = np.repeat(np.arange(words.n_docs), words.counts())
    parts = [(words.hash, doc, words.start, words.end)]
    for n in OPENINGS:
        longer = np.flatnonzero(words.end - words.start > n)
        start = words.start[longer]
        h = mixed((total[start + n] - total[start]) * back[start] + np.uint64(n))
        parts.append((h, doc[longer], start, start + n))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _term_slices(column: pa.Array) -> Iterator[tuple[int, int, Words, tuple]]:
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _NO_LETTER)
        yield a, b, words, _terms(words)


class Index:
    """Terms with their weights, and the examples in blocks."""

    def __init__(self, terms: list[tuple[int, str]], n: int, df: np.ndarray, neighbours: int = NEIGHBOURS):
        order = np.argsort(np.array([t for t, _ in terms], np.int64).view(np.uint64), kind="stable")
        self.term = np.array([terms[i][0] for i in order], np.int64).view(np.uint64)
        self.shown = [terms[i][1] for i in order]
        self.idf = np.log((1 + n) / (1 + df[order])) + 1
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.term >> np.uint64(48)).astype(np.int64)] = True
        self.k = neighbours
        self.empty = 0.0

    def vectors(self, column: pa.Array) -> Iterator[dict[int, float]]:
        """Unit TF-IDF vectors as {term: weight}."""
        for a, b, words, (h, doc, _, _) in _term_slices(column):
            rows: list[dict[int, float]] = [{} for _ in range(b - a)]
            if len(self.term):
                maybe = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.term, h[maybe]), len(self.term) - 1)
                known = self.term[at] == h[maybe]
                pair, tf = np.unique(doc[maybe[known]] * len(self.term) + at[known], return_counts=True)
                weight = (1 + np.log(tf)) * self.idf[pair % len(self.term)]
                for d, t, w in zip((pair // len(self.term)).tolist(), (pair % len(self.term)).tolist(), weight.tolist()):
                    rows[d][t] = w
            for row in rows:
                norm = sum(w * w for w in row.values()) ** 0.5
                yield {t: w / norm for t, w in row.items()}

    def add(self, ids: list[int], vectors: list[dict[int, float]], labels: list[float]) -> None:
        """Examples without a term set the score of such texts; the others are indexed."""
        bare = [y for v, y in zip(vectors, labels) if not v]
        self.empty = (sum(bare) + 0.5 * sum(labels) / max(len(labels), 1)) / (len(bare) + 0.5) if labels else 0.5
        # alike examples side by side, so that the maxima of a block are telling
        rows = sorted((max(v, key=v.get), i, y, v) for i, v, y in zip(ids, vectors, labels) if v)
        self.ids, self.label = [r[1] for r in rows], np.array([r[2] for r in rows])
        blocks = -(-len(rows) // BLOCK)
        self.most = np.zeros((len(self.term), blocks))
        postings: list[list[dict[int, list]]] = [[{} for _ in range(blocks)]]
        for at, (_, _, _, v) in enumerate(rows):
            for t, w in v.items():
                self.most[t, at // BLOCK] = max(self.most[t, at // BLOCK], w)
                postings[0][at // BLOCK].setdefault(t, []).append((at % BLOCK, w))
        self.postings = [
            {t: (np.array([p for p, _ in x]), np.array([w for _, w in x])) for t, x in block.items()}
            for block in postings[0]
        ]

    def nearest(self, vector: dict[int, float]) -> list[tuple[float, int]]:
        """(similarity, example) of the k nearest with any similarity, best first; ties by position."""
        terms = list(vector)
        bound = np.array([vector[t] for t in terms]) @ self.most[terms]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or len(best) == self.k and bound[block] < -best[-1][0]:
                break
            cosine = np.zeros(BLOCK)
            for t in terms:
                if (p := self.postings[block].get(t)) is not None:
                    cosine[p[0]] += vector[t] * p[1]
            got = np.flatnonzero(cosine > 0)
            best = sorted(best + [(-cosine[i], block * BLOCK + i) for i in got.tolist()])[: self.k]
        return [(-s, i) for s, i in best]

    def score(self, vector: dict[int, float]) -> tuple[float, list[dict]]:
        near = self.nearest(vector) if vector and len(self.label) else []
        if not near:
            return self.empty, []
        votes = PRIOR * self.empty + sum(s * self.label[i] for s, i in near)
        top = [{"id": self.ids[i], "label": self.label[i], "similarity": float(s)} for s, i in near[:3]]
        return float(min(max(votes / (PRIOR + sum(s for s, _ in near)), 0.0), 1.0)), top


def fit(examples: DataFrame, terms: int = TERMS, least: float = LEAST) -> Index:
    """An index of stored (id, text, label) examples, which are bounded.

    How many examples hold each term is counted over all of them by a distributed
    aggregate; only the chosen terms and the examples' sparse vectors are collected.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(1).to_pylist())
            for a, b, words, (h, doc, start, end) in _term_slices(batch.column(0)):
                _, once = np.unique(np.stack([h.view(np.int64), doc]), axis=1, return_index=True)
                value, first, group = np.unique(h[once], return_index=True, return_inverse=True)
                n = np.bincount(group)
                bad = np.bincount(group, weights=label[a:b][doc[once]])
                raw = words.data.tobytes()
                where = once[first]
                shown = [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[where].tolist(), end[where].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(shown), pa.array(n), pa.array(bad)], ["term", "shown", "n", "bad"]
                )

    size = examples.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    n, bad = size[0], size[1]
    good = n - bad
    table = (
        examples.select("text", "label")
        .mapInArrow(count, "term long, shown string, n long, bad double")
        .groupBy("term")
        .agg(F.min("shown").alias("shown"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .where(F.col("n") >= max(4, n // 1000))
    )
    expected = F.col("n") * bad / max(n, 1)
    chi = n * (F.col("bad") - expected) ** 2 / (expected * (1 - F.col("n") / max(n, 1)) * (good or 1))
    chosen = (
        table.withColumn("chi", chi).where((F.col("bad") > expected) & (F.col("chi") >= least)).orderBy(F.desc("chi"), "term").limit(terms).collect()
        if bad and good
        else []
    )
    index = Index([(r.term, r.shown) for r in chosen], n, np.array([r.n for r in chosen], float))
    shared = examples.sparkSession.sparkContext.broadcast(index)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(shared.value.vectors(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([list(v) for v in rows], pa.list_(pa.int64())),
                 pa.array([list(v.values()) for v in rows], pa.list_(pa.float64()))], ["id", "label", "terms", "weights"]
            )

    got = examples.select("text", "id", "label").mapInArrow(
        vectors, "id long, label double, terms array<long>, weights array<double>"
    ).collect()  # bounded
    got.sort(key=lambda r: (r.id, r.label, r.terms))
    index.add([r.id for r in got], [dict(zip(r.terms, r.weights)) for r in got], [r.label for r in got])
    return index


def score_toxicity(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, evidence (the three nearest examples) and terms for each row; no shuffle.

    A text without a chosen term, also a null or empty one, scores the rate among
    such examples. Repeated rows score alike; ties of similarity go by position.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    evidence = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kept = shared.value, {}
        for batch in batches:
            score, near, shown = [], [], []
            for v in index.vectors(batch.column(1)):
                key = tuple(v.items())
                if key not in kept:
                    if len(kept) > 50_000:
                        kept.clear()
                    kept[key] = index.score(v)
                s, e = kept[key]
                score.append(s)
                near.append(e)
                shown.append([index.shown[t] for t in v])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array(near, evidence), pa.array(shown, pa.list_(pa.string()))],
                ["id", "score", "evidence", "terms"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        run, "id long, score double, evidence array<struct<id: long, label: double, similarity: double>>, terms array<string>"
    ).withColumnRenamed("id", id_col)
