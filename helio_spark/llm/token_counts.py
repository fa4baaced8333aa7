"""Token counts by byte-pair merging, without making token ids.

Each text is split by the published byte-level pattern. A piece's bytes form a
linked list of symbols; a heap gives the adjacent pair of lowest rank, leftmost
first, until none is left. Its count is its number of bytes less the merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the published split of byte-level vocabularies, white space by its Unicode property
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pieces kept with their counts by a Python worker, and the longest piece that is kept.
KEPT_PIECES, KEPT_CHARS = 1_500_000, 40
#: Pieces of a text held at once.
PIECES_AT_ONCE = 200_000


def read_merges(path: str) -> dict:
    """What counting needs of a byte-level vocabulary in JSON: bytes, merges and special strings."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)
    ids = vocabulary["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves
    hidden = [b for b in range(256) if b not in set(shown)]  # the others, as 256, 257, ...
    char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    merges, made = {}, []
    for rank, pair in enumerate(vocabulary["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges.setdefault(ids[left] << 32 | ids[right], rank)
        made.append(ids[left + right])
    return {
        "bytes": [ids[char[b]] for b in range(256)],
        "merges": merges,
        "made": made,
        "special": sorted((t["content"] for t in vocabulary["added_tokens"]), key=len, reverse=True),
    }


def merged_count(piece: bytes, symbols: list[int], merges: dict[int, int], made: list[int]) -> int:
    """Symbols left of a piece after all merges."""
    symbol = [symbols[b] for b in piece]
    rank_of, left = merges.get, len(symbol)
    last = left - 1
    # the rank of each symbol with its right neighbour; -1 where there is no merge
    rank = [rank_of(a << 32 | b, -1) for a, b in zip(symbol, symbol[1:])]
    bits = left.bit_length()
    heap = [r << bits | i for i, r in enumerate(rank) if r >= 0]
    heapify(heap)
    low = (1 << bits) - 1
    following = list(range(1, left + 1))
    before = list(range(-1, last))
    while heap:
        top = heappop(heap)
        i = top & low
        r = top >> bits
        if rank[i] != r:
            continue  # one of the two has been merged since
        left -= 1
        j = following[i]
        k = following[i] = following[j]
        new = symbol[i] = made[r]
        if j < last:
            rank[j] = -1
        if k <= last:
            before[k] = i
            r = rank[i] = rank_of(new << 32 | symbol[k], -1)
            if r >= 0:
                heappush(heap, r << bits | i)
        else:
            rank[i] = -1
        h = before[i]
        if h >= 0:
            r = rank[h] = rank_of(symbol[h] << 32 | new, -1)
            if r >= 0:
                heappush(heap, r << bits | h)
    return left


class Kept(dict):
    """Counts of pieces, computed when first asked for; long pieces are not kept."""

    def __init__(self, vocabulary: dict):
        super().__init__()
        self.rules = vocabulary["bytes"], vocabulary["merges"], vocabulary["made"]

    def __missing__(self, piece: str) -> int:
        n = merged_count(piece.encode("utf-8", "surrogatepass"), *self.rules)
        if len(piece) <= KEPT_CHARS:
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts; counts of short pieces are kept between texts."""

    def __init__(self, vocabulary: dict):
        self.split = regex.compile(SPLIT)
        special = vocabulary["special"]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.kept = Kept(vocabulary)

    def _pieces(self, text: str) -> int:
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        count = self.kept.__getitem__
        if len(text) <= PIECES_AT_ONCE:
            return sum(map(count, self.split.findall(text)))
        found, total = (m[0] for m in self.split.finditer(text)), 0
        while some := list(islice(found, PIECES_AT_ONCE)):
            total += sum(map(count, some))
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._pieces(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._pieces, parts))


_COUNTERS: dict[int, Counter] = {}


def token_counts(
    docs: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row; one pass, no shuffle.

    A null or empty text has 0 tokens, repeated rows are counted each, a null id
    stays null, other columns are not read. Special strings inside a text count
    as one token each. The vocabulary (one file, some MB) is read by the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_merges(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(id(shared.value))
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[id(shared.value)] = Counter(shared.value)
        for batch in batches:
            texts = (t or "" for t in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(map(counter.count, texts), pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
