"""Repeated byte strings across documents, by prefix-free parsing spread over tasks.

A rolling-hash trigger begins a phrase, so equal text is cut alike wherever it is. Each
phrase is taken with the bytes that follow it as far as its strings of ``length`` bytes
reach; the distinct ones are the dictionary, and a document's phrases are its parse. A
phrase is owned by the least document that holds it: every other one repeats all
strings that begin in it, so highly repetitive text leaves after one exchange of
digests. In what is owned, strings are put in order by their suffixes: a suffix of
the dictionary's phrases needs no more than its first ``length`` bytes here, which lie
within its extended phrase, so the parse decides no tie that a result could see.
Neighbours in that order with the same bytes name the least owner of a string.

Only suffixes that can have an equal are sorted. A string's anchor is the least
hash of its ``ANCHOR``-byte parts, which equal strings share; runs of strings with one
anchor are sent together, if the anchor occurs in two documents' owned phrases. Tasks
collapse what they send: one record for each digest, anchor or run, however many of
their documents have it, and an answer is a bit for each record. What a record's
least document is not told to be first in, others do not own either.

Batches of documents are rows, kept on disk and dealt once by batch; all later joins bring
the bits to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helio_spark.llm import text as t
from helio_spark.llm.text import powers, slices, utf8
from helio_spark.session import materialize

LENGTH = 50
#: Bytes of a trigger and of an anchor.
TRIGGER, ANCHOR = 16, 24
#: An anchor that a batch has in this many runs counts as hot.
MANY = 127


@dataclass(frozen=True)
class Sizes:
    """How the work is cut; results are the same for any."""

    phrase: int = 256  #: mean bytes of a phrase
    piece: int = 1 << 18  #: bytes of text hashed at once
    batch: int = 4 << 20  #: bytes of text in one row of batches
    range: int = 16 << 20  #: bytes of text for whose anchors or runs there is one group
    run: int = 64  #: strings of a run at most
    sort: int = 1 << 18  #: strings sorted at once
    hot: int = 4096  #: an anchor of more runs has its strings sent one by one, by their own digest


OUT = "n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _rolled(data: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from each place; its upper bits are the best."""
    places = max(0, len(data) - n + 1)
    return (total[n:][:places] - total[:places]) * powers(t._INVERSE, places or 1)[:places]


def _least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours."""
    have = 1
    while have * 2 <= n:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start .. start + n - 1 of each, one after the other."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(n.sum())


class Parse:
    """Phrases of a batch and, if asked for, the runs of strings with one anchor; places are bytes of the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, takes_part: np.ndarray, length: int, runs: bool, sizes: Sizes):
        self.data, self.offsets, self.length, self.sizes = data, offsets, length, sizes
        phrases, found, base = [], [], 0
        for first, last in slices(offsets, sizes.piece):
            for start, stop in self._pieces(offsets[first], offsets[last], last - first == 1):
                phrase, run = self._piece(start, stop, first, last, takes_part, runs)
                if runs:
                    run[2] += base
                    found.append(run)
                phrases.append(phrase)
                base += phrase.shape[1]
        self.start, self.last = np.concatenate(phrases, 1) if phrases else np.zeros((2, 0), np.int64)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.digest = self.digests(self.start, self.last + length)
        if runs:
            whole = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
            self.run_start, self.run_last, self.run_phrase = whole[:3]
            self.anchor = whole[3].view(np.uint64)
            self.run_doc = self.doc[self.run_phrase]

    def _pieces(self, start: int, end: int, alone: bool) -> Iterator[tuple[int, int]]:
        step = self.sizes.piece if alone else max(1, end - start)
        for a in range(start, end, step):
            yield a, min(a + step, end)

    def _piece(self, start, stop, first, last, takes_part, runs) -> tuple[np.ndarray, np.ndarray | None]:
        """[first string, last string] of phrases that begin in [start, stop), and [first, last, phrase, anchor] of runs."""
        n = self.length
        end = min(stop + n - 1, self.offsets[last])
        data = self.data[start:end]
        begins = np.maximum(self.offsets[first:last], start) - start
        ends = np.minimum(self.offsets[first + 1 : last + 1], end) - start
        strings = max(0, len(data) - n + 1)
        step = np.zeros(strings + 1, np.int32)
        own = takes_part[first:last] & (ends - begins >= n)
        np.add.at(step, begins[own], 1)
        np.add.at(step, ends[own] - n + 1, -1)
        at = np.flatnonzero(np.cumsum(step[:-1]))
        if not len(at):
            return np.zeros((2, 0), np.int64), np.zeros((4, 0), np.int64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(t._BYTE_VALUES[data] * powers(t._BASE, len(data)), out=total[1:])
        cut = np.zeros(len(data) + 1, np.int64)
        cut[: len(data) - TRIGGER + 1] = _rolled(data, total, TRIGGER) < np.uint64(2**64 // self.sizes.phrase)
        cut[begins] = 1
        phrase = np.cumsum(cut)[at]
        new = np.ones(len(at), bool)
        new[1:] = phrase[1:] != phrase[:-1]
        edge = np.flatnonzero(new)
        phrases = np.stack([at[edge], at[np.append(edge[1:], len(at)) - 1]]) + start
        if not runs:
            return phrases, None
        anchor = _least_of(_rolled(data, total, ANCHOR), n - ANCHOR + 1)[at]
        number = np.cumsum(new) - 1
        new[1:] |= anchor[1:] != anchor[:-1]
        edge = np.flatnonzero(new)
        within = np.arange(len(at)) - np.repeat(edge, np.diff(np.append(edge, len(at))))
        edge = np.flatnonzero(within % self.sizes.run == 0)
        return phrases, np.stack([at[edge] + start, at[np.append(edge[1:], len(at)) - 1] + start, number[edge], anchor[edge].view(np.int64)])

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128 bits of each range of bytes."""
        view = memoryview(np.ascontiguousarray(self.data))
        found = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
        return np.frombuffer(found, np.uint64).reshape(-1, 2)


class Records:
    """Distinct digests of a batch in a fixed order, with the least id of each and the range each goes to."""

    def __init__(self, digest: np.ndarray, ids: np.ndarray, ranges: int, route: np.ndarray | None = None):
        order = np.lexsort((ids, digest[:, 1], digest[:, 0]))
        new = np.ones(len(order), bool)
        sorted_ = digest[order]
        new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
        self.one = order[new]  # an occurrence with the least id
        self.key, self.id = digest[self.one], ids[self.one]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        way = self.key[:, 0] if route is None else route[self.one]
        self.part = ((way >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(self.part, kind="stable")
        edge = np.flatnonzero(np.diff(self.part[order], prepend=-1))
        for a, b in zip(edge, np.append(edge[1:], len(order))):
            yield int(self.part[order[a]]), order[a:b]


def _bits(answers, kind: int) -> dict[int, np.ndarray]:
    """{range: bits} of one kind of answer."""
    return {x["part"]: np.unpackbits(np.frombuffer(x["bits"], np.uint8)).astype(bool) for x in answers or () if x["kind"] == kind}


def _answered(records: Records, answers, kind: int) -> np.ndarray:
    out, got = np.zeros(len(records.one), bool), _bits(answers, kind)
    for part, which in records.parts():
        out[which] = got[part][: len(which)]
    return out


SENT = "part int, kind int, batch long, key binary, id binary, info binary"
ANSWER = "batch long, part int, kind int, bits binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    names = ["part", "kind", "batch", "key", "id", "info"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _answer(rows: list[tuple]) -> pa.Table:
    kinds, names = (pa.int64(), pa.int32(), pa.int32(), pa.binary()), ["batch", "part", "kind", "bits"]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _joined(table: pa.Table, column: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of all blobs of a column and where each blob begins (and the last ends)."""
    blobs = [np.frombuffer(x.as_py(), kind) for x in table.column(column)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
    return np.concatenate(blobs), at


def _replies(table: pa.Table, part: int, kind: int, bits: np.ndarray, at: np.ndarray) -> list[tuple]:
    batches = table.column("batch").to_pylist()
    return [(b, part, kind, np.packbits(bits[at[i] : at[i + 1]]).tobytes()) for i, b in enumerate(batches)]


def _first_of(columns: tuple[np.ndarray, ...], ids: np.ndarray) -> np.ndarray:
    """The least id among rows that agree in all columns, for each row."""
    order = np.lexsort((ids, *columns))
    new = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for c in columns:
        sorted_ = c[order]
        same &= sorted_[1:] == sorted_[:-1]
    new[1:] = ~same
    out = np.empty(len(order), np.int64)
    out[order] = ids[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
    return out


def _owners(table: pa.Table) -> pa.Table:
    """Is the record's id the least of its digest? Records of one range."""
    part, kind = table.column("part")[0].as_py(), table.column("kind")[0].as_py()
    key, _ = _joined(table, "key", np.uint64)
    ids, at = _joined(table, "id", np.int64)
    key = key.reshape(-1, 2)
    return _answer(_replies(table, part, kind, _first_of((key[:, 1], key[:, 0]), ids) == ids, at))


def _shared(table: pa.Table, hot: int) -> pa.Table:
    """Which anchors (by 32 bits within their range) are in two documents, and which have more than ``hot`` runs."""
    part = table.column("part")[0].as_py()
    key, at = _joined(table, "key", np.uint32)
    info, _ = _joined(table, "info", np.uint8)
    _, group, records = np.unique(key, return_inverse=True, return_counts=True)
    often = np.bincount(group, weights=info & MANY) > hot
    often |= np.bincount(group, weights=(info & MANY) == MANY) > 0
    two = (records > 1) | (np.bincount(group, weights=info >> 7) > 0)
    return _answer(_replies(table, part, 0, two[group], at) + _replies(table, part, 1, often[group], at))


def _sorted_runs(length: int, at_once: int):
    """For each string of each run: does a smaller id own it? Suffixes are sorted by their first ``length`` bytes."""
    columns, tail = length // 8, length % 8

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        data, _ = _joined(table, "key", np.uint8)
        info, at = _joined(table, "info", np.dtype([("anchor", "<u4"), ("strings", "u1")]))
        ids, _ = _joined(table, "id", np.int64)
        strings = info["strings"].astype(np.int64)
        begin = np.cumsum(strings + length - 1) - (strings + length - 1)
        bit = np.cumsum(strings) - strings
        hit = np.zeros(strings.sum(), bool)
        order = np.argsort(info["anchor"], kind="stable")
        groups = np.flatnonzero(np.diff(info["anchor"][order].astype(np.int64), prepend=-1))
        sums = np.add.reduceat(strings[order], groups) if len(groups) else np.zeros(0, np.int64)
        words = np.lib.stride_tricks.as_strided(np.append(data, np.zeros(8, np.uint8)), (len(data) + 1, 8), (1, 1))
        a = 0
        while a < len(groups):  # whole anchors, about ``at_once`` strings together
            b = a + max(1, int(np.searchsorted(np.cumsum(sums[a:]), at_once, "right")))
            which = order[groups[a] : groups[b] if b < len(groups) else len(order)]
            place, own = spread(begin[which], strings[which]), np.repeat(ids[which], strings[which])
            suffix = [np.ascontiguousarray(words[place + 8 * k]).view(">u8").ravel().astype(np.uint64) for k in range(columns)]
            if tail:
                suffix.append(np.ascontiguousarray(words[place + length - 8]).view(">u8").ravel().astype(np.uint64))
            hit[spread(bit[which], strings[which])] = _first_of(tuple(reversed(suffix)), own) < own
            a = b
        edges = np.append(bit, strings.sum())[at]
        return _answer(_replies(table, part, 0, hit, edges))

    return run


class Batch:
    """One row of the stored batches."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.named = np.frombuffer(row["named"], bool)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.data = np.frombuffer(zstandard.decompress(row["text"], max_output_size=max(1, row["size"])), np.uint8)

    def parse(self, length: int, sizes: Sizes, runs: bool = True) -> Parse:
        return Parse(self.data, self.offsets, self.named, length, runs, sizes)


BATCHES = "batch long, size long, ids binary, named binary, offsets binary, text binary"


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        first, ids = batch.column(0), batch.column(1)
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        data, offsets = utf8(batch.column(2))
        for a, b in slices(offsets, size):
            at = offsets[a : b + 1]
            text = np.ascontiguousarray(data[at[0] : at[-1]])
            row = (first[a].as_py(), len(text), ids[a:b].tobytes(), named[a:b].tobytes(), (at - at[0]).tobytes(), press.compress(text))
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["batch", "size", "ids", "named", "offsets", "text"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row: a row is a batch of documents."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _owned(parse: Parse, phrases: Records, ids: np.ndarray, answers) -> np.ndarray:
    """Phrases that no smaller id has."""
    return _answered(phrases, answers, 0)[phrases.of] & (ids[parse.doc] == phrases.id[phrases.of])


class Anchors(Records):
    """Distinct anchors of a batch's owned runs: how many runs have each, and whether two documents do."""

    def __init__(self, anchor: np.ndarray, ids: np.ndarray, ranges: int):
        order = np.argsort(anchor, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = anchor[order[1:]] != anchor[order[:-1]]
        edge = np.flatnonzero(new)
        self.one = order[edge]
        self.low = anchor[self.one].astype(np.uint32)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.count = np.diff(np.append(edge, len(order)))
        other = np.zeros(len(order), bool)
        other[1:] = ids[order[1:]] != ids[order[:-1]]
        self.two = np.add.reduceat((other & ~new).astype(np.int64), edge) > 0 if len(edge) else np.zeros(0, bool)
        self.part = ((anchor[self.one] >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)


class Runs:
    """Shared runs of a batch, as records of whole runs, or of single strings where the anchor is hot."""

    def __init__(self, parse: Parse, ids: np.ndarray, owned: np.ndarray, answers, anchor_ranges: int, ranges: int):
        mine = np.flatnonzero(owned[parse.run_phrase])
        run_ids = ids[parse.run_doc[mine]]
        anchors = Anchors(parse.anchor[mine], run_ids, anchor_ranges)
        shared, hot = (_answered(anchors, answers, k)[anchors.of] for k in (0, 1))
        n = parse.length
        cold = mine[shared & ~hot]
        self.start, self.strings = parse.run_start[cold], parse.run_last[cold] - parse.run_start[cold] + 1
        self.ids = run_ids[shared & ~hot]
        digest = parse.digests(self.start, self.start + self.strings + n - 1)
        self.records = Records(digest, self.ids, ranges, parse.anchor[cold])
        self.anchor = parse.anchor[cold]
        single = mine[shared & hot]
        count = parse.run_last[single] - parse.run_start[single] + 1
        self.string, self.string_ids = spread(parse.run_start[single], count), np.repeat(run_ids[shared & hot], count)
        self.singles = Records(parse.digests(self.string, self.string + n), self.string_ids, ranges)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, sizes: Sizes = Sizes()) -> DataFrame:
    """id, n_bytes, spans and kept of every row: texts without strings that a smaller id has.

    Each byte covered by a ``length``-byte string that also begins in a row with a
    smaller id goes; overlaps count, and strings are judged on the input. ``spans`` are
    the maximal removed ranges of bytes in order, ``kept`` the other bytes (which may
    cut a code point). Matches never cross rows. A null text is empty. Rows with one
    id do not remove each other's text; a row without id is left as it is and removes nothing.
    Ids are whole numbers. Other columns may have any names; an empty table gives no rows.

    Batches stay on disk (``DISK_ONLY``) until ``spark.catalog.clearCache()``. They are named
    by the place of their first row, so ``docs`` should be a stored table, which is read
    in the same order again when an executor is lost.
    """
    if length < 2 * ANCHOR or sizes.run > 255:
        raise ValueError(f"strings of at least {2 * ANCHOR} bytes, runs of at most 255")
    spark = docs.sparkSession
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = (
        docs.select(F.monotonically_increasing_id().alias("batch"), F.col(id_col).cast("long"), F.col(text_col).cast("string"))
        .mapInArrow(lambda batches: _pack(batches, sizes.batch), BATCHES).repartition(deal, "batch").persist(StorageLevel.DISK_ONLY)
    )
    size = stored.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    phrase_ranges, ranges = size // (32 * sizes.range) + 12, size // sizes.range + 12

    def send_phrases(batches):
        for row in _rows(batches):
            batch = Batch(row)
            parse = batch.parse(length, sizes, runs=False)
            phrases = Records(parse.digest, batch.ids[parse.doc], phrase_ranges)
            out = [(p, 0, row["batch"], phrases.key[w].tobytes(), phrases.id[w].tobytes(), None) for p, w in phrases.parts()]
            yield _sent(out)

    def send_anchors(batches):
        for row in _rows(batches):
            batch = Batch(row)
            parse = batch.parse(length, sizes)
            phrases = Records(parse.digest, batch.ids[parse.doc], phrase_ranges)
            owned = _owned(parse, phrases, batch.ids, row["phrases"])
            mine = owned[parse.run_phrase]
            anchors = Anchors(parse.anchor[mine], batch.ids[parse.run_doc[mine]], ranges)
            info = (np.minimum(anchors.count, MANY) | anchors.two.astype(np.int64) << 7).astype(np.uint8)
            yield _sent([(p, 0, row["batch"], anchors.low[w].tobytes(), None, info[w].tobytes()) for p, w in anchors.parts()])

    def found_runs(row) -> tuple[Batch, Parse, np.ndarray, Runs]:
        batch = Batch(row)
        parse = batch.parse(length, sizes)
        phrases = Records(parse.digest, batch.ids[parse.doc], phrase_ranges)
        owned = _owned(parse, phrases, batch.ids, row["phrases"])
        return batch, parse, owned, Runs(parse, batch.ids, owned, row["anchors"], ranges, ranges)

    def send_runs(batches):
        for row in _rows(batches):
            batch, _, _, runs = found_runs(row)
            out = []
            for p, w in runs.records.parts():
                one = runs.records.one[w]
                place = spread(runs.start[one], runs.strings[one] + length - 1)
                info = np.empty(len(one), np.dtype([("anchor", "<u4"), ("strings", "u1")]))
                info["anchor"], info["strings"] = runs.anchor[one].astype(np.uint32), runs.strings[one]
                out.append((p, 0, row["batch"], batch.data[place].tobytes(), runs.records.id[w].tobytes(), info.tobytes()))
            for p, w in runs.singles.parts():
                out.append((p, 1, row["batch"], runs.singles.key[w].tobytes(), runs.singles.id[w].tobytes(), None))
            yield _sent(out)

    def settle(table: pa.Table) -> pa.Table:
        return _owners(table) if table.column("kind")[0].as_py() else _sorted_runs(length, sizes.sort)(table)

    def remove(batches):
        for row in _rows(batches):
            batch, parse, owned, runs = found_runs(row)
            step = np.zeros(len(batch.data) + 1, np.int32)

            def mark(start: np.ndarray, strings: np.ndarray | int = 1) -> None:
                np.add.at(step, start, 1)
                np.add.at(step, start + strings + length - 1, -1)

            mark(parse.start[~owned], (parse.last - parse.start + 1)[~owned])
            least = runs.records.id[runs.records.of] == runs.ids
            mark(runs.start[~least], runs.strings[~least])
            got, n = _bits(row["runs"], 0), runs.strings[runs.records.one]
            begin = np.cumsum(n) - n
            hit = np.zeros(n.sum(), bool)
            for p, w in runs.records.parts():
                at = spread(begin[w], n[w])
                hit[at] = got[p][: len(at)]
            own = np.flatnonzero(least)
            place = spread(runs.start[own], runs.strings[own])
            mark(place[hit[spread(begin[runs.records.of[own]], runs.strings[own])]])
            first = _answered(runs.singles, row["runs"], 1)[runs.singles.of] & (runs.singles.id[runs.singles.of] == runs.string_ids)
            mark(runs.string[~first])
            yield _cut(batch, np.cumsum(step[:-1]) > 0)

    def answers(sent: DataFrame, keys: list[str], reply, label: str) -> DataFrame:
        found = materialize(sent.groupBy(*keys).applyInArrow(reply, ANSWER), f"{label}-bits")
        return found.groupBy("batch").agg(F.collect_list(F.struct("part", "kind", "bits")).alias(label))

    phrases = answers(stored.mapInArrow(send_phrases, SENT), ["part"], _owners, "phrases")
    known = stored.join(phrases, "batch", "left")
    anchors = answers(known.mapInArrow(send_anchors, SENT), ["part"], lambda table: _shared(table, sizes.hot), "anchors")
    known = known.join(anchors, "batch", "left")
    runs = answers(known.mapInArrow(send_runs, SENT), ["part", "kind"], settle, "runs")
    return known.join(runs, "batch", "left").mapInArrow(remove, f"id long, {OUT}").withColumnRenamed("id", id_col)


def _cut(batch: Batch, gone: np.ndarray) -> pa.RecordBatch:
    """The documents of a batch without the bytes that go."""
    offsets = batch.offsets
    edge = np.zeros(len(gone) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros_like(gone), np.zeros_like(gone)
    before[1:], after[:-1] = gone[:-1], gone[1:]
    start = np.flatnonzero(gone & (~before | edge[:-1]))
    end = np.flatnonzero(gone & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(doc, np.arange(len(offsets)))
    base = offsets[:-1][doc]
    spans = pa.ListArray.from_arrays(
        pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["start", "end"])
    )
    stay = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(stay.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(batch.data[~gone]))])
    ids = pa.array(batch.ids, mask=~batch.named)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(offsets)), spans, kept.cast(pa.binary())], ["id", "n_bytes", "spans", "kept"]
    )
