"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task cuts its documents into shards of about a megabyte and sorts the
suffixes of a shard's words. Every suffix of every test item is then looked up by
binary search, one word deeper at a time, which gives its longest verbatim match
and all places of it, and on the way all places of its n-word window. Words that
no test item has, and runs too short for any window, cannot be part of a match
and are left out before the sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helio_spark.llm.text import NOT_ALNUM, Words, slices, utf8
from helio_spark.session import materialize

#: Test words that one pass holds: 16 bytes each on the driver and in each task.
BLOCK_WORDS = 2_000_000

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField(
            "matches",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("item", T.StringType()),
                        T.StructField("item_word", T.LongType()),
                        T.StructField("doc_word", T.LongType()),
                        T.StructField("n_words", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)


class TestWords:
    """The test items of one block: their words as small numbers, 0 after each item."""

    def __init__(self, items: list[str], texts: list[str], window: int):
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        words = Words(data, offsets, NOT_ALNUM)
        have = words.counts()
        keep = np.flatnonzero(have > 0)
        self.items = [items[i] for i in keep]
        length = have[keep]
        self.vocabulary, number = np.unique(words.hash, return_inverse=True)
        first = np.concatenate([[0], np.cumsum(length + 1)])
        self.text = np.zeros(first[-1] + 1, np.int32)
        doc = np.repeat(np.arange(len(keep)), length)
        at = np.arange(len(number)) + doc  # one gap for each item before
        self.text[at] = number + 1
        self.suffix = at
        self.item = doc
        self.place = at - first[:-1][doc]
        self.window = np.minimum(window, length)[doc] if len(keep) else np.zeros(0, np.int64)
        self.shortest = int(self.window.min()) if len(keep) else 0
        self.longest = int(length.max()) if len(keep) else 0
        self.near = np.zeros(1 << 16, bool)  # quick no for words that no item has
        self.near[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True


def _suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of nonzero numbers, sorted by the ``depth`` numbers that follow (zeros end a text)."""
    rank, step = text.astype(np.int64), 1
    while step < depth:
        later = np.zeros_like(rank)
        later[:-step] = rank[step:] if step < len(rank) else 0
        later[rank == 0] = 0
        key = rank * (int(rank.max()) + 1) + later
        _, rank = np.unique(key, return_inverse=True)
        rank = np.where(text == 0, 0, rank + 1)
        step *= 2
    order = np.argsort(rank, kind="stable")
    return order[np.searchsorted(rank[order], 1) :]


def _first(text, order, depth, low, high, word):
    """First place in [low, high) of ``order`` whose number at ``depth`` is ``word`` or more."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        less = open_ & (text[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(text) - 1)] < word)
        low = np.where(less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)


def search(text: np.ndarray, tests: TestWords) -> tuple[np.ndarray, ...]:
    """(place, test word, length) of every window's places, and the same of the longest matches."""
    none = np.zeros(0, np.int64)
    order = _suffix_array(text, tests.longest)
    if not len(order):
        return none, none, none, none, none, none
    active = np.arange(len(tests.suffix))
    low, high = np.zeros(len(active), np.int64), np.full(len(active), len(order), np.int64)
    windows, longest = [], []

    def spread(low, high, test, length):
        n = high - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return order[at], np.repeat(test, n), np.repeat(length, n)

    for depth in range(tests.longest + 1):
        word = tests.text[tests.suffix[active] + depth]
        new_low = _first(text, order, depth, low, high, word)
        new_high = _first(text, order, depth, new_low, high, word + 1)
        on = (word > 0) & (new_low < new_high)
        ended = ~on & (depth >= tests.window[active])
        if ended.any():
            longest.append(spread(low[ended], high[ended], active[ended], np.full(ended.sum(), depth)))
        active, low, high = active[on], new_low[on], new_high[on]
        if not len(active):
            break
        whole = tests.window[active] == depth + 1
        if whole.any():
            windows.append(spread(low[whole], high[whole], active[whole], tests.window[active[whole]]))
    join = lambda parts: [np.concatenate(x) for x in zip(*parts)] if parts else [none] * 3
    return *join(windows), *join(longest)


def _shard(words: Words, tests: TestWords):
    """Found places of a slice of documents, as (document, start, end, test) and (document, place, test, length)."""
    maybe = np.flatnonzero(tests.near[(words.hash >> np.uint64(48)).astype(np.int64)])
    at = np.searchsorted(tests.vocabulary, words.hash[maybe])
    at[at == len(tests.vocabulary)] = 0
    known = tests.vocabulary[at] == words.hash[maybe]
    number = np.zeros(len(words.hash) + 1, np.int32)
    number[maybe[known]] = at[known] + 1
    doc = np.repeat(np.arange(words.n_docs), words.counts())
    inside = number[:-1] > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    run = np.cumsum(begins) - 1
    long_run = np.bincount(run[inside], minlength=1) >= max(tests.shortest, 1)
    kept = np.flatnonzero(inside)
    kept = kept[long_run[run[kept]]]
    gap = np.cumsum(begins[kept]) - 1  # a zero between two runs
    place = np.arange(len(kept)) + gap
    text = np.zeros(len(kept) + (gap[-1] if len(kept) else 0) + 2, np.int32)
    text[place] = number[kept]
    word_of = np.zeros(len(text), np.int64)
    word_of[place] = kept
    p, test, length, lp, ltest, llength = search(text, tests)
    begin, lbegin = word_of[p], word_of[lp]
    base = words.first
    return (
        (doc[begin], begin - base[doc[begin]], begin - base[doc[begin]] + length, tests.item[test]),
        (doc[lbegin], lbegin - base[doc[lbegin]], ltest, llength),
    )


def _hit_rows(found, matches, n_docs: int, n_words: np.ndarray, tests: TestWords, with_matches: bool) -> list[dict]:
    rows = [{"n_words": int(n), "hits": [], "items": [], "matches": []} for n in n_words]
    doc, start, end, item = found
    for d, i in np.unique(np.stack([doc, item]), axis=1).T.tolist() if len(doc) else []:
        rows[d]["items"].append(tests.items[i])
    order = np.lexsort((start, doc))
    for d, s, e in zip(doc[order].tolist(), start[order].tolist(), end[order].tolist()):
        hits = rows[d]["hits"]
        if hits and s <= hits[-1]["end"]:
            hits[-1]["end"] = max(hits[-1]["end"], e)
        else:
            hits.append({"start": s, "end": e})
    if with_matches:
        for d, p, t, n in zip(*(x.tolist() for x in matches)):
            rows[d]["matches"].append(
                {"item": tests.items[tests.item[t]], "item_word": int(tests.place[t]), "doc_word": p, "n_words": n}
            )
    return rows


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[TestWords]:
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")
    ).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 2  # words are two or more characters apart
    n = int(size // block_words) + 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = part.collect()
        yield TestWords([r.item for r in rows], [r.text for r in rows], window)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    matches: bool = True,
    block_words: int = BLOCK_WORDS,
    name: str = "contamination",
) -> DataFrame:
    """Each row of ``docs`` with a struct column ``name`` of what it has of the test items.

    ``n_words``: words of the text (A-Z lower-cased; runs of a-z, 0-9 and non-ASCII).
    ``hits``: merged word ranges inside places of a window (``window`` consecutive
    words of an item; all words of a shorter one). ``items``: ids of items with
    such a place. ``matches``: for each suffix of an item, its longest verbatim
    matches of at least a window and where they are.

    A null or empty text has no words; repeated rows are each searched; items
    without words match nothing and a null item id counts as the empty string.
    Test items are read to the driver in blocks of ``block_words`` words, one pass
    over the documents for each (one, for any usual benchmark). No shuffle.
    """
    if name in docs.columns:
        raise ValueError(f"docs already has a column {name}")
    columns = docs.columns
    sc = docs.sparkSession.sparkContext
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, window, block_words)):
        shared = sc.broadcast(block)
        at = columns.index(text_col)
        schema = T.StructType([*docs.schema.fields[: len(columns)], T.StructField(name, FOUND)])

        def run(batches, shared=shared, at=at, first=k == 0):
            tests = shared.value
            for batch in batches:
                data, offsets = utf8(batch.column(at))
                rows = []
                for a, b in slices(offsets):
                    here = offsets[a : b + 1]
                    words = Words(data[here[0] : here[-1]], here - here[0], NOT_ALNUM)
                    found, longest = _shard(words, tests)
                    rows += _hit_rows(found, longest, words.n_docs, words.counts(), tests, matches)
                if not first:
                    rows = [_joined(x, y) for x, y in zip(batch.column(batch.num_columns - 1).to_pylist(), rows)]
                arrays = batch.columns if first else batch.columns[:-1]
                names = batch.schema.names if first else batch.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(rows, _ARROW_FOUND)], [*names, name])

        if k:
            docs = materialize(docs, name)  # one block at a time in a task
        docs = docs.mapInArrow(run, schema)
    return docs


_PAIR = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
_ARROW_FOUND = pa.struct(
    [("n_words", pa.int64()), ("hits", pa.list_(_PAIR)), ("items", pa.list_(pa.string())), ("matches", pa.list_(_MATCH))]
)


def _joined(a: dict, b: dict) -> dict:
    """What two blocks of test items found in one row."""
    hits: list[dict] = []
    for x in sorted(a["hits"] + b["hits"], key=lambda x: x["start"]):
        if hits and x["start"] <= hits[-1]["end"]:
            hits[-1]["end"] = max(hits[-1]["end"], x["end"])
        else:
            hits.append(dict(x))
    return {
        "n_words": b["n_words"],
        "hits": hits,
        "items": list(dict.fromkeys(a["items"] + b["items"])),
        "matches": a["matches"] + b["matches"],
    }


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, **columns) -> DataFrame:
    """``docs`` without the rows that hold any window of a test item; columns as they are."""
    name = "contamination"
    while name in docs.columns:
        name += "_"
    found = find_contamination(docs, benchmark, window, matches=False, name=name, **columns)
    return found.where(F.size(F.col(f"{name}.hits")) == 0).drop(name)


def contamination_digest(found: DataFrame, id_col: str = "doc_id", name: str = "contamination") -> DataFrame:
    """Counts and a digest of the sorted item ids for each row of ``find_contamination``."""
    words = F.aggregate(f"{name}.hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        F.col(id_col),
        F.col(f"{name}.n_words").alias("n_words"),
        words.alias("n_hit"),
        F.size(f"{name}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(f"{name}.items")), 256).alias("items_sha256"),
        (words > 0).alias("contaminated"),
    )
