"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen when the smallest hash of its inner s-mers
belongs to its first or its last s-mer. The choice depends on the k-mer alone, so
an edit moves only the anchors it touches. A fingerprint is the smallest
``SIZE`` anchor hashes of a text, in hexadecimal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helio_spark.llm.text import mixed, powers
from helio_spark.session import materialize

K, S, SIZE = 12, 4, 64
#: Code points that are hashed at once; a longer text is hashed alone.
SLICE_CHARS = 400_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def text_anchors(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and hashes of the closed syncmers of each text; a text under k is one anchor."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    some: list[str] = []
    size = 0
    for text in texts:
        if some and size + len(text) > SLICE_CHARS:
            out += _anchors(some, k, s)
            some, size = [], 0
        some.append(text)
        size += len(text)
    return out + (_anchors(some, k, s) if some else [])


def _anchors(texts: list[str], k: int, s: int) -> list[tuple[np.ndarray, np.ndarray]]:
    length = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(length)])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(code.astype(np.uint64) + np.uint64(1)) * powers(_BASE, max(n, 1))[:n], out=total[1:])
    back = powers(_INVERSE, n + 1)

    def hashes(at: np.ndarray | slice, to) -> np.ndarray:
        return mixed((total[to] - total[at]) * back[at])

    chosen = np.zeros(0, np.int64)
    if n >= k:
        small = hashes(slice(0, n - s + 1), slice(s, n + 1))
        width = k - s + 1
        least = _sliding_min(small, width)
        edge = (small[: n - k + 1] == least) | (small[width - 1 :] == least)
        chosen = np.flatnonzero(edge)
        doc = np.searchsorted(first, chosen, "right") - 1
        chosen = chosen[chosen + k <= first[doc + 1]]
    value = hashes(chosen, chosen + k)
    cut = np.searchsorted(chosen, first)
    out = []
    for i in range(len(texts)):
        a, b = cut[i], cut[i + 1]
        if a < b:
            out.append((chosen[a:b] - first[i], value[a:b]))
        elif length[i]:  # shorter than k
            whole = hashes(np.array([first[i]]), np.array([first[i + 1]]))
            out.append((np.zeros(1, np.int64), whole))
        else:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
    return out


def _sketches(texts: list[str], k: int, s: int, size: int) -> list[np.ndarray]:
    return [
        np.unique((value >> np.uint64(32)).astype(np.uint32))[:size] for _, value in text_anchors(texts, k, s)
    ]


def _bytes(sketch: np.ndarray) -> bytes:
    return sketch.astype(">u4").tobytes()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of the smallest anchors of both texts that both have; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """id and an array of (position, anchor) in order of position, for matching places of texts.

    A text shorter than k is one anchor; null or empty texts have none. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int64()), ("anchor", pa.int64())]))
        for batch in batches:
            found = text_anchors([t or "" for t in batch.column(1).to_pylist()], k, s)
            rows = [
                [{"position": p, "anchor": h} for p, h in zip(at.tolist(), value.view(np.int64).tolist())]
                for at, value in found
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "anchors"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, anchors array<struct<position: long, anchor: long>>").withColumnRenamed(
        "id", id_col
    )


_FIELDS = [
    ("kind", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()),
    ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_SCHEMA = (
    "kind int, part int, id long, text string, n_chars long, edited_sha256 binary, fingerprint binary, "
    "edited_fingerprint binary, near_edited double, near_next double"
)
_INNER, _FIRST, _LAST = 0, 1, 2


def _compared(ids: list, texts: list[str], following: list[str], k: int, s: int, size: int, part: int) -> dict:
    """Result columns of texts that know the text after them."""
    cut = [len(t) // 4 for t in texts]
    edited = [t[: len(t) - c] + f[:c] for t, c, f in zip(texts, cut, following)]
    own, changed = _sketches(texts, k, s, size), _sketches(edited, k, s, size)
    other = own[1:] + _sketches(following[-1:], k, s, size)
    for i in range(len(texts) - 1):
        if following[i] is not texts[i + 1]:  # rows that aren't neighbours
            other[i] = _sketches([following[i]], k, s, size)[0]
    n = len(texts)
    return {
        "kind": [_INNER] * n, "part": [part] * n, "id": ids, "text": [None] * n, "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in edited],
        "fingerprint": [_bytes(x) for x in own], "edited_fingerprint": [_bytes(x) for x in changed],
        "near_edited": [likeness(a, b, size) for a, b in zip(own, changed)],
        "near_next": [likeness(a, b, size) for a, b in zip(own, other)],
    }


def _edge(kind: int, part: int, doc: int | None, text: str) -> pa.RecordBatch:
    row = dict.fromkeys(n for n, _ in _FIELDS) | {"kind": kind, "part": part, "id": doc, "text": text}
    return pa.RecordBatch.from_pylist([row], pa.schema(_FIELDS))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, size: int = SIZE
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last quarter replaced by the beginning of the next
    text in ascending id (the first one follows the last; null ids come first,
    texts of one id by their hash). Equal texts have equal fingerprints; null is
    an empty text with an empty fingerprint; one row alone is followed by itself.

    One shuffle of the texts into even ranges of (id, hash), so that neighbours
    meet in a task. Only the last row of a range has its neighbour elsewhere: the
    ranges' edges are stored with the results and joined by range number.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("_hash", F.xxhash64("text"))
    ranges = rows.repartitionByRange("id", "_hash").sortWithinPartitions("id", "_hash", "text").drop("_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            if held is None:
                yield _edge(_FIRST, part, ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(ids) > 1:
                done = _compared(ids[:-1], texts[:-1], texts[1:], k, s, size, part)
                yield pa.RecordBatch.from_pydict(done, pa.schema(_FIELDS))
        if held is not None:
            yield _edge(_LAST, part, *held)

    stored = materialize(ranges.mapInArrow(run, _SCHEMA), "fingerprints")
    first = stored.where(F.col("kind") == _FIRST).select("part", F.col("text").alias("following"))
    last = stored.where(F.col("kind") == _LAST).select("part", "id", "text")
    # one row for each range of the shuffle
    order = Window.orderBy("part")
    succeed = last.select("part").withColumn("next", F.lead("part").over(order)).withColumn(
        "next", F.coalesce("next", F.min("part").over(order))
    )
    edges = last.join(succeed, "part").join(first.withColumnRenamed("part", "next"), "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.to_pydict()
            if row["id"]:
                done = _compared(row["id"], row["text"], row["following"], k, s, size, 0)
                yield pa.RecordBatch.from_pydict(done, pa.schema(_FIELDS))

    edges = edges.select("id", "text", "following").mapInArrow(finish, _SCHEMA)
    return stored.where(F.col("kind") == _INNER).unionByName(edges).select(
        F.col("id").alias(id_col), "n_chars",
        *[F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
        "near_edited", "near_next",
    )
