"""Removal of repeated byte strings against a plain loop over all strings."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from helio_spark.llm import phrase_dedup as pd
from helio_spark.llm.text import utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, length):
    """(id, n_bytes, spans, kept) by the definition, without any hash or order."""
    least = {}
    for i, text in rows:
        data = (text or "").encode()
        if i is not None:
            for a in range(len(data) - length + 1):
                s = data[a : a + length]
                least[s] = min(i, least.get(s, i))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if i is not None:
            for a in range(len(data) - length + 1):
                if least[data[a : a + length]] < i:
                    gone[a : a + length] = b"\1" * length
        spans, at = [], 0
        while (at := gone.find(1, at)) >= 0:
            end = gone.find(0, at)
            end = len(data) if end < 0 else end
            spans.append((at, end))
            at = end
        out.append((i, len(data), spans, bytes(x for x, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def got(frame, **options):
    rows = pd.remove_repeats(frame, **options).collect()
    return sorted([(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows], key=str)


def corpus(seed, n, alphabet="ab \né"):
    """Texts made of shared pieces of 10 to 400 characters, edited here and there."""
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    pool = [piece(rng.randrange(10, 400)) for _ in range(25)]
    rows = []
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.6 else piece(rng.randrange(1, 120)) for _ in range(rng.randrange(0, 8))]
        text = "".join(parts)
        if text and rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + "X" + text[at + 1 :]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("length", [48, 50, 64])
def test_all_strings(spark, length):
    rows = corpus(length, 150)
    rng = random.Random(1)
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(frame, length=length) == brute(rows, length)


def test_hot_anchors_small_pieces_and_batches(spark):
    sizes = pd.Sizes(phrase=64, piece=500, batch=2000, range=20_000, run=8, sort=40, hot=3)
    rows = corpus(5, 80, "abcdefgh ") + [(100 + i, "z" * 700 + str(i)) for i in range(5)]
    line = "the same long line stands in every one of these documents, word for word"
    rows += [(200 + i, f"{i * 7919} {line}{i * 104729} tail") for i in range(40)]
    local = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert got(local, sizes=sizes) == brute(rows, 50)


def test_odd_rows_and_clashing_columns(spark):
    a, b = "one text that is a good deal longer than fifty bytes, so it counts", "é" * 60
    rows = [
        (3, a), (3, a), (1, a + b), (2, b), (None, a), (None, None), (4, None), (5, ""), (6, "short"), (7, a[:50]), (8, a[:49]),
        (9, "x" + a + a + b), (9, "y"), (10, "q" * 40_000), (11, "q" * 60),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clash = frame.selectExpr("*", "'x' as batch", "'x' as size", "'x' as spans", "'x' as kept", "'x' as n_bytes", "'x' as id")
    assert got(clash) == brute(rows, 50)
    assert got(frame.limit(0)) == []
    with pytest.raises(ValueError, match="at least"):
        pd.remove_repeats(frame, length=20)


def test_equal_text_is_cut_alike_wherever_it_stands():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefghij ") for _ in range(6000))
    texts = [shared, "before " + shared + " after", "x" * 777 + shared]
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    parse = pd.Parse(data, offsets, np.ones(3, bool), 50, True, pd.Sizes())
    phrases = [set(map(tuple, parse.digest[parse.doc == d])) for d in range(3)]
    assert len(phrases[0]) > 10
    assert len(phrases[0] & phrases[1]) >= len(phrases[0]) - 2 and len(phrases[0] & phrases[2]) >= len(phrases[0]) - 2
