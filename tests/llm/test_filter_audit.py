"""The byte transducer and the filter audit against plain loops."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa

from helio_spark.llm import filter_audit as fa
from helio_spark.llm.text import utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def texts(seed, n):
    rng = random.Random(seed)
    letters = "aAéZ \n\t#|€\U0001f600 x\x1c\x00"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 3_000))) for _ in range(n)]


def test_measures_by_loop():
    rows = [*texts(1, 60), "", " ", "\U0001f600" * 5_000, "ab " * 9_000, "x" * 70_000, "é" * 600, f"{'y' * 300} {'y' * 299} {'y' * 300} {'y' * 299}z"]
    data, offsets = utf8(pa.array(rows, pa.large_string()))
    assert fa.measure_slice(data, offsets).tolist() == [measures(t) for t in rows]


def test_table_meets_words_whose_hashes_agree(monkeypatch):
    monkeypatch.setattr(fa, "mixed", lambda x: np.zeros_like(x))  # every word wants the same slot
    rows = ["a b a abcdefgh abcdefghi abcdefgh abcdefghj", "a b"]
    data, offsets = utf8(pa.array(rows, pa.large_string()))
    assert fa.measure_slice(data, offsets)[:, 1].tolist() == [5, 2]


def test_malformed_bytes_are_code_points():
    data = np.frombuffer(b"a\x80b \xe2\x82 \xf0", np.uint8)
    assert fa.measure_slice(data, np.array([0, len(data)]))[0].tolist() == [3, 3, 0, 7, 0]


def brute(docs, labels):
    first = {}
    for i, t, _, _, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, bad = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    rows = []
    for i, t, _, s, _ in docs:
        n, u, c, m, y = measures(t or "")
        fails = {"A"} if n < 200 else set()
        fails |= ({"B"} if 2 * u < n else set()) | ({"C"} if 100 * c > 2 * m else set()) | ({"D"} if y else set())
        fails |= {"E"} if i is not None and i > first[t or ""] else set()
        rows.append((s or "", fails, i is not None and i in good, i is not None and i in bad))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = set(order[: step - 1])
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                mine = [r[1] for r in rows if r[0] == part and f in r[1]]
                out[part, order, step] = [
                    len(left), len(gone), sum(bool(x & before) for x in mine), sum(x == {f} for x in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone), f,
                ]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = shapley[v[-1]]
    return out


def test_audit_by_loop_with_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [
        (1, long, "en", "a", 1), (2, long, "en", "a", 1), (2, long, "en", "b", 1), (3, long + " A" * 200, "en", None, 1),
        (4, None, None, "", None), (5, "", "en", "a", 0), (None, long, "en", "a", 1), (None, "", "en", "b", 1),
        (6, "w " * 500, "en", "b", 1), (7, "w " * 500, "en", "b", 1), (7, "w " * 500, "en", "b", 1), (8, "x $", "de", "c", 3),
    ]
    labels = [(2, 1, 0), (2, 0, 1), (5, 1, None), (None, 1, 1), (7, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame(docs, DOCS)
    for c in ("id", "part", "digest", "bits", "n_words", "n", "low", "least", "_0", "good"):
        frame = frame.withColumn(c, frame["lang"])
    got = fa.audit_filters(frame.repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got} == brute(docs, labels)
    assert len(got) == 4 * 600


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert fa.audit_filters(none, spark.createDataFrame([], LABELS)).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    assert fa.audit_filters(one, spark.createDataFrame([], LABELS)).count() == 600
