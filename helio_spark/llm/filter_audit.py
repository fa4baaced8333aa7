"""Measures of whole texts by one byte transducer, and how filters over them interact.

The transducer is a table: (state, class of the next byte) gives the next state and
an output, which says whether the byte begins a word, ends one, begins a code point,
is a capital or a symbol. States are: between words, and within a word with 0 to 3
bytes of a code point still to come. The state depends on the last four bytes only,
so a text is cut in lanes which are run side by side, each from four bytes before
its start. Spans of words that the outputs mark go into an open-addressing hash table;
a word joins a slot only if its bytes equal those of the word that holds it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helio_spark.llm.text import SLICE_BYTES, mixed, slices, utf8

WHITE, CAPITAL, SYMBOL, OTHER, TAIL, LEAD2, LEAD3, LEAD4, BORDER = range(9)
SYMBOLS = b"#$%&*|"
BETWEEN, WORD = 0, 1  # 1 + k: in a word, k bytes of a code point to come
#: Outputs of a step.
POINT, CAP, SYM, IN = 1, 2, 4, 8

#: A byte that UTF-8 never has stands between documents.
SEPARATOR = 0xFF
BACK = 4
#: Words of more bytes are hashed and compared one by one, others eight bytes at a time side by side.
LONG = 256
MEASURES = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[list(b" \t\n\x0b\x0c\r")] = WHITE
    out[65:91] = CAPITAL
    out[list(SYMBOLS)] = SYMBOL
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:0xF8] = TAIL, LEAD2, LEAD3, LEAD4
    out[SEPARATOR] = BORDER
    return out


def _table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for 16 x state + class. A stray byte is a code point of its own."""
    after, out = np.zeros(16 * 5, np.uint8), np.zeros(16 * 5, np.uint8)
    for state in range(5):
        for kind in range(9):
            at = 16 * state + kind
            if kind in (WHITE, BORDER):
                after[at], out[at] = BETWEEN, POINT if kind == WHITE else 0
            elif kind == TAIL and state > WORD:
                after[at], out[at] = state - 1, IN
            else:
                after[at] = WORD + max(0, kind - LEAD2 + 1)
                out[at] = IN | POINT | {CAPITAL: CAP, SYMBOL: SYM}.get(kind, 0)
    return after, out


CLASS = _classes()
AFTER, OUTPUT = _table()


def transduce(data: np.ndarray, lane: int = 512) -> np.ndarray:
    """The output of every byte; ``data`` begins at a border of documents."""
    n = len(data)
    lanes = max(1, -(-n // lane))
    kinds = np.full(BACK + lanes * lane, BORDER, np.uint8)
    kinds[BACK : BACK + n] = CLASS[data]
    rows = np.lib.stride_tricks.sliding_window_view(kinds, BACK + lane)[::lane]
    columns = np.ascontiguousarray(rows.T)
    out = np.empty((lane, lanes), np.uint8)
    state = np.zeros(lanes, np.uint8)
    for j in range(BACK + lane):
        at = state * np.uint8(16) + columns[j]
        if j >= BACK:
            OUTPUT.take(at, out=out[j - BACK])
        state = AFTER.take(at)
    return np.ascontiguousarray(out.T).ravel()[:n]


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Indexes of the spans that are the first of their bytes in their document.

    An open-addressing table of spans: each span tries its slot, an empty one goes
    to the first span that wants it, and a span meets its like only if document,
    length and every byte agree; else it moves to the next slot.
    """
    n = len(start)
    if n == 0:
        return np.zeros(0, np.int64)
    length = end - start
    hashed = np.full(n, 0x9E3779B97F4A7C15, np.uint64) + doc.astype(np.uint64)
    packed = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(packed, (len(data) + 1, 8), (1, 1))
    keep = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)

    def piece(span: np.ndarray, depth: int) -> np.ndarray:
        left = np.minimum(length[span] - depth, 8)
        return np.ascontiguousarray(words[start[span] + depth]).view(np.uint64).ravel() & keep[left]

    for i in np.flatnonzero(length > LONG).tolist():  # few: each has over LONG bytes
        own = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        hashed[i] += np.frombuffer(own, np.uint64)[0]
    span, depth = np.flatnonzero(length <= LONG), 0
    while len(span):
        hashed[span] = mixed(hashed[span] * np.uint64(0x9E3779B97F4A7C15) + piece(span, depth))
        depth += 8
        span = span[length[span] > depth]

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        equal = (hashed[a] == hashed[b]) & (doc[a] == doc[b]) & (length[a] == length[b])
        for i in np.flatnonzero(equal & (length[a] > LONG)).tolist():
            equal[i] = np.array_equal(data[start[a[i]] : end[a[i]]], data[start[b[i]] : end[b[i]]])
        at, depth = np.flatnonzero(equal & (length[a] <= LONG)), 0
        while len(at):
            agree = piece(a[at], depth) == piece(b[at], depth)
            equal[at[~agree]] = False
            depth += 8
            at = at[agree & (length[a[at]] > depth)]
        return equal

    mask = np.uint64((1 << max(4, int(2 * n - 1).bit_length())) - 1)
    table = np.full(int(mask) + 1, n, np.int64)
    active, slot, first = np.arange(n), hashed & mask, []
    while len(active):
        at = slot.astype(np.int64)
        free = table[at] == n
        np.minimum.at(table, at[free], active[free])  # slots that are taken keep their span
        met = same(active, table[at])
        first.append(active[table[at] == active])
        active, slot = active[~met], (slot[~met] + np.uint64(1)) & mask
    return np.sort(np.concatenate(first))


def measure_slice(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The five measures (columns) of each document (rows) of a slice; ``offsets`` begin at 0."""
    n = len(offsets) - 1
    spaced = np.full(len(data) + n, SEPARATOR, np.uint8)
    text = np.ones(len(spaced), bool)
    border = offsets[1:] + np.arange(n)
    text[border] = False
    spaced[text] = data
    out = transduce(spaced)
    inside = (out & IN).astype(bool)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.concatenate([[0], border + 1])
    doc = np.searchsorted(border, start)
    result = np.zeros((n, len(MEASURES)), np.int64)
    result[:, 0] = np.bincount(doc, minlength=n)
    result[:, 1] = np.bincount(doc[distinct_spans(spaced, start, end, doc)], minlength=n)
    for column, mark in ((2, CAP), (3, POINT), (4, SYM)):
        total = np.concatenate([[0], np.cumsum((out & mark) > 0)])
        result[:, column] = total[first[1:] - 1] - total[first[:-1]]
    return result


def measure_texts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep``, then n_words, n_distinct, n_capitals, n_chars, n_symbols and digest of every row.

    Words are runs without ASCII white space, case-sensitive; a null text counts as
    empty. ``digest`` (128 bits) names the text's bytes. The text itself does not
    leave the task. Columns in ``keep`` may have any name but these.
    """
    named = [f"_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            found, digests = [np.zeros((0, len(MEASURES)), np.int64)], []
            for a, b in slices(offsets, SLICE_BYTES):
                at = offsets[a : b + 1]
                found.append(measure_slice(data[at[0] : at[-1]], at - at[0]))
            view = memoryview(np.ascontiguousarray(data))
            for a, b in zip(offsets[:-1], offsets[1:]):
                digests.append(hashlib.blake2b(view[a:b], digest_size=16).digest())
            values = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(values[:, i]) for i in range(len(MEASURES))], pa.array(digests, pa.binary())],
                [*named, *MEASURES, "digest"],
            )

    rows = docs.select(*[F.col(c).alias(x) for c, x in zip(keep, named)], F.col(text_col).cast("string").alias("text"))
    kinds = [f"{x} {rows.schema[x].dataType.simpleString()}" for x in named]
    measured = rows.mapInArrow(run, ", ".join([*kinds, *[f"{m} long" for m in MEASURES], "digest binary"]))
    return measured.select(*[F.col(x).alias(c) for x, c in zip(named, keep)], *MEASURES, "digest")


#: Failure conditions of the audit's first four filters; the last one is copies.
CONDITIONS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "n_symbols > 0",
}
COPY = "E"


def failing_counts(
    docs: DataFrame, labels: DataFrame, conditions: dict[str, str] | None = None, copy_filter: str = COPY,
    id_col: str = "doc_id", part_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(part, fails, n, good, toxic): how many rows of a part fail exactly a set of filters.

    ``fails`` has one bit for each filter, in the order of ``conditions`` and then
    the copy filter, which a row fails if a row with a smaller id has its text. Rows
    with one id fail it alike; a row without an id neither fails it nor makes others fail.
    ``good`` and ``toxic`` count rows whose id has a label quality = 1, toxic = 1 (in any
    of its label rows). A null part is the empty string.

    Rows carry numbers and a digest only. Equal texts fail the other filters alike, so
    rows are counted by (id, digest, part) next to the join with labels, and copies
    meet as one row for each digest, part and label: a text that a third of all rows
    share is as cheap as any other.
    """
    conditions = CONDITIONS if conditions is None else conditions
    measured = measure_texts(docs, text_col, (id_col, part_col)).toDF("id", "part", *MEASURES, "digest")
    bits = sum(F.when(F.expr(c), 1 << i).otherwise(0) for i, c in enumerate(conditions.values()))
    narrow = measured.select("id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), "digest", bits.cast("int").alias("bits"))
    known = (
        labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("bad"))
    )
    rows = (
        narrow.groupBy("id", "digest", "part", "bits").agg(F.count(F.lit(1)).alias("n"))
        .join(known, "id", "left")
        .select("id", "digest", "part", "bits", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    )
    # rows of one id, digest and part were one row: the least id of a group comes with its count
    groups = rows.groupBy("digest", "part", "bits", "good", "bad").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("free"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("low"),
    )
    least = F.min("low.id").over(Window.partitionBy("digest"))
    first = F.when(F.col("low.id") == F.col("least"), F.col("low.n")).otherwise(0)
    alone = groups.withColumn("least", least).withColumn("kept", F.col("free") + F.coalesce(first, F.lit(0)))
    copy = 1 << len(conditions)
    sides = F.explode(F.array(F.struct(F.col("bits").alias("fails"), F.col("kept").alias("n")), F.struct((F.col("bits") + copy).alias("fails"), (F.col("n") - F.col("kept")).alias("n"))))
    return (
        alone.select("part", "good", "bad", sides.alias("s"))
        .groupBy("part", "s.fails")
        .agg(F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("good")).alias("good"), F.sum(F.col("s.n") * F.col("bad")).alias("toxic"))
    )


def order_effects(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """What each filter does at each place of every order, from ``failing_counts``.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. A part has at most 2 ** filters sets of failures, which are one
    row; every order is arithmetic on them. In how many orders a filter is first among
    those that a row fails depends on their number alone, which gives ``shapley``.
    """
    if len(letters) > 5:
        raise ValueError("more than five filters have too many orders to list")
    orders = ["".join(p) for p in permutations(letters)]
    steps = []
    for order in orders:
        before = 0
        for step, letter in enumerate(order):
            steps.append({"o": order, "s": step + 1, "b": before, "f": 1 << letters.index(letter)})
            before |= 1 << letters.index(letter)
    sets = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    plan = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,s:int,b:int,f:int>>"))

    def total(value: str, which) -> Column:
        return F.aggregate(F.filter("sets", which), F.lit(0).cast("long"), lambda a, x: a + x[value])

    fails, before, own = (lambda x: x["fails"]), F.col("p.b"), F.col("p.f")
    hit = lambda x: (fails(x).bitwiseAND(own) != 0) & (fails(x).bitwiseAND(before) == 0)
    share = F.aggregate(
        F.filter("sets", lambda x: fails(x).bitwiseAND(own) != 0), F.lit(0).cast("long"),
        lambda a, x: a + x["n"] * (F.lit(len(orders)) / F.bit_count(x["fails"])).cast("long"),
    )
    return sets.select("part", "sets", plan.alias("p")).select(
        "part", F.col("p.o").alias("filter_order"), F.col("p.s").alias("step"),
        total("n", lambda x: fails(x).bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", hit).alias("removed"),
        total("n", lambda x: (fails(x).bitwiseAND(own) != 0) & (fails(x).bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda x: fails(x) == own).alias("unique_fails"),
        total("good", hit).alias("good_lost"), total("toxic", hit).alias("toxic_lost"), share.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Every order of the five filters over each part; see ``failing_counts`` for odd rows.

    Each part that occurs has all orders and steps, zeros included; an empty table
    gives no rows.
    """
    return order_effects(failing_counts(docs, labels, **columns))
