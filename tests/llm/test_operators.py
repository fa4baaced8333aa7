"""Operators against brute force and libraries, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helio_spark.llm import language, line_dedup, quality, syncmers, toxicity
from helio_spark.llm.components import connected
from helio_spark.llm.decontaminate import contamination_digest, decontaminate, find_contamination
from helio_spark.llm.examples import labelled_examples
from helio_spark.llm.line_dedup import dedup_lines
from helio_spark.llm.mixing import mix
from helio_spark.llm.ngram_join import PARITY, near_duplicates, parity_of, suffix_may_match
from helio_spark.llm.queries import QUERIES
from helio_spark.llm.token_counts import Counter, read_merges, token_counts
from helio_spark.llm.warc import chunked, page_digest, parse, read_warc, unchunked, write_warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_docs(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows."""
    base = words(1, 60)
    near = base[:30] + ["other"] + base[31:]
    rows = [
        (1, " ".join(base), "en", "a", 1), (2, " ".join(near), "en", "b", 1), (2, " ".join(near), "en", "b", 1),
        (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n ", "en", None, 4), (6, "one two", "de", "c", 7),
        (7, "ONE  two", "de", "c", 8), (8, " ".join(words(2, 40_000)), "fr", "a", 1), (None, " ".join(words(3, 50)), "en", "b", 1),
        (9, "é" * 5, None, "b", 5),
    ]
    return spark.createDataFrame(rows, DOCS)


def everything(spark, docs, tmp_path):
    """Each operator's rows over ``docs``."""
    marks = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "w1 w2"), (None, "one two"), (3, None)], "item_id long, text string")
    votes = quality.fit(labelled_examples(docs, marks, "quality", F.lit(True), 100))
    index = toxicity.fit(labelled_examples(docs, marks, "toxic", F.lit(True), 100))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))
    write_warc(pages, f"{tmp_path}/warc")
    return {
        "mix": mix(docs), "lines": dedup_lines(docs), "syncmers": syncmers.fingerprints(docs),
        "anchors": syncmers.anchors(docs), "contamination": find_contamination(docs, items),
        "quality": quality.score_quality(docs, votes), "toxicity": toxicity.score_toxicity(docs, index),
        "near": near_duplicates(docs), "language": language.predict_language(docs, language.fit(docs, F.lit(True))),
        "tokens": token_counts(docs, PATH), "warc": read_warc(spark, f"{tmp_path}/warc"),
    }


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = odd_docs(spark).withColumns({c: F.lit("x") for c in ("id", "class", "g", "size", "copies", "target", "key", "line", "k", "o", "no")})
    for name, got in everything(spark, docs, tmp_path).items():
        assert got.count() == 11, name


def test_empty_tables(spark, tmp_path):
    for name, got in everything(spark, odd_docs(spark).limit(0), tmp_path).items():
        assert got.count() == 0, name


def test_equal_rows_are_mixed_each(spark):
    rows = [(7, "w " * 3, "en", "a", 6)] * 600 + [(i, "w " * 5, "en", "b", 10) for i in range(1000, 1100)]
    for parts in (1, 7):
        got = mix(spark.createDataFrame(rows, DOCS).repartition(parts)).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
        assert {r.source: abs(r.taken - r.target) <= {"a": 3, "b": 5}[r.source] for r in got} == {"a": True, "b": True}


def test_tilt_solves_the_dual(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(["w"] * (1 + int(rng.expovariate(0.02)))), "en", rng.choice("abcde"), 0) for i in range(3000)]
    rows = mix(spark.createDataFrame(docs, DOCS)).collect()
    for source in "abcde":
        own = [r for r in rows if r.source == source]
        assert sum(r.rate * r["size"] for r in own) == pytest.approx(own[0].target, rel=1e-6)  # the token constraint
        fit = [(r["size"], math.log(r.rate)) for r in own if r.rate < 3]
        if len(fit) > 2:  # an exponential tilt: log rate is a line in size
            (x0, y0), (x1, y1) = min(fit), max(fit)
            slope = (y1 - y0) / max(1, x1 - x0)
            assert all(y == pytest.approx(y0 + slope * (x - x0), abs=1e-6) for x, y in fit)


def test_mix_follows_targets(spark):
    rng = random.Random(4)
    sizes = {"a": 300, "b": 200, "c": 100, None: 5}
    rows = [(f"{s}{i}", s, " ".join(["w"] * rng.randrange(1, 60))) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(i, t, None, s, 0) for i, (_, s, t) in enumerate(rows)], DOCS)
    got = [r.asDict() for r in mix(docs).collect()]
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mix(docs.repartition(5)).collect())
    own = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in sizes}
    weight, total, full = dict(zip(["a", "b", "c", None], [1, 2, 3, 1])), sum(own.values()), set()
    while True:  # the rule as it is told
        rest = total - sum(3 * own[s] for s in full)
        share = sum(weight[s] for s in own if s not in full)
        target = {s: 3 * own[s] if s in full else rest * weight[s] / share for s in own}
        new = {s for s in own if s not in full and target[s] > 3 * own[s]}
        if not new:
            break
        full |= new
    assert None in full
    for s in own:
        mine = [r for r in got if r["source"] == s]
        assert {round(r["target"], 6) for r in mine} == {round(target[s], 6)}
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 30
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)


def test_lines(spark):
    long = words(5, 40)
    other = long[:20] + ["changed"] + long[21:]
    docs = spark.createDataFrame(
        [(2, "short line\n" + " ".join(other) + "\nlast", "x"), (1, " ".join(long) + "\nshort line", "y"), (3, None, "z"), (4, " ".join(long).upper(), "v")],
        "doc_id long, text string, extra string",
    )
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.extra) for r in dedup_lines(docs).collect()}
    assert got == {
        1: (" ".join(long) + "\nshort line", 2, 0, "y"), 2: ("last", 3, 2, "x"), 3: (None, 0, 0, "z"), 4: ("", 1, 1, "v"),
    }


def test_lines_by_loop_over_all_pairs(spark):
    rng = random.Random(8)
    pool = [words(i, rng.randrange(0, 45), 60) for i in range(40)]

    def line():
        out = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 2])):
            if out:
                out[rng.randrange(len(out))] = f"W{rng.randrange(9)}é"
        return rng.choice(["", "  ", "\t"]).join([" ".join(out), ""])

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(0, 9)))) for i in range(60)] + [(90, ""), (91, None), (92, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_o", "o", "k", "nos", "h1", "slot"):
        docs = docs.withColumn(c, F.lit(c))
    got = {r.doc_id: r for r in dedup_lines(docs.repartition(5)).collect()}
    seen = []
    for i, text in sorted(rows):
        kept, lines = [], [] if text is None else text.split("\n")
        for one in lines:
            w = one.lower().split()
            own = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
            if not own or not any(4 * len(own & x) >= 3 * len(own | x) for x in seen):
                kept.append(one)
            seen += [own] if own else []
        r = got[i]
        assert (r.text, r.n_lines, r.n_removed) == (None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)), i
        assert r["_o"] == "_o" and r["nos"] == "nos"


def test_fingerprints_by_brute_force(spark):
    texts = [" ".join(words(i, 5 + 40 * (i % 4))) for i in range(60)] + ["", None, "ab", "ab"]
    docs = spark.createDataFrame([(7 * i, t, None, None, 0) for i, t in enumerate(texts)], DOCS).repartition(6)
    got = {r.doc_id: r for r in syncmers.fingerprints(docs).collect()}
    shown = lambda t: "".join(f"{v:08x}" for v in syncmers._sketches([t], syncmers.K, syncmers.S, syncmers.SIZE)[0])
    for i, t in enumerate(texts):
        t, after, r = t or "", texts[(i + 1) % len(texts)] or "", got[7 * i]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (shown(t), shown(edited))
        assert 0 <= r.near_next <= 1 and (r.near_edited > 0.3 if len(t) > 200 else True)


def test_syncmers_do_not_depend_on_context():
    text = "".join(chr(97 + random.Random(i).randrange(26)) for i in range(300))
    (at, value), (at2, value2) = syncmers.text_anchors([text, "préfixe" + text])
    inner = dict(zip((at2 - 7).tolist(), value2.tolist()))
    assert len(at) > 30 and all(inner[p] == v for p, v in zip(at.tolist(), value.tolist()))


def test_contamination(spark):
    text = words(6, 300)
    items = spark.createDataFrame([("i1", " ".join(text[50:75])), ("i2", "only here"), ("i3", "!!")], "item_id string, text string")
    docs = spark.createDataFrame(
        [(1, " ".join(text)), (2, "a only, HERE b only here"), (3, "clean"), (4, " ".join(text[50:59])), (5, None)], "doc_id long, text string"
    )
    for block in (2_000_000, 1):  # one pass, and one for each block of items
        found = find_contamination(docs, items, block_words=block)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination_digest(found).collect()}
        assert got == {1: (300, 25, 1, True), 2: (6, 4, 1, True), 3: (1, 0, 0, False), 4: (9, 0, 0, False), 5: (0, 0, 0, False)}
    longest = {(m.item_word, m.doc_word, m.n_words) for m in find_contamination(docs, items).where("doc_id = 1").first().contamination.matches}
    assert (0, 50, 25) in longest and (10, 60, 15) in longest
    assert sorted(r.doc_id for r in decontaminate(docs, items).collect()) == [3, 4, 5]


def test_near_duplicates_by_brute_force(spark):
    rng, texts = random.Random(8), []
    for g in range(12):
        base = words(100 + g, rng.choice([4, 8, 30, 120]))
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.5 else base  # drifting copies
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in map(str.split, texts)]
    part = list(range(len(texts)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_suffix_filter_never_loses():
    import numpy as np

    rng = np.random.default_rng(9)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in "ab")
        common = len(np.intersect1d(a, b))
        assert suffix_may_match(a, b, common)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in connected(links).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_token_counts_equal_the_library():
    library, counter, rng = Tokenizer.from_file(PATH), Counter(read_merges(PATH)), random.Random(3)
    letters = "aAé ñ  \t\n\r\x0b\x1c\x1d\x85\xa0'’sdlm!#0١Ⅷ日本🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", "a<|endoftext|> <|endoftext|>", "a" * 50_000, "x " * 3000, "\x00\x01"]
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunks_and_archives(spark, tmp_path):
    for payload in (b"", b"x" * 5000, b"\r\n0\r\n\r\n", "é\r\n\r\nWARC/1.1\r\n".encode() * 300):
        assert unchunked(chunked(payload, 7)) == payload
    html = ["same", "same", "", None, "é\r\n\r\nWARC/1.1\r\n" * 900, "y" * 20_000]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)] + [(5, "u", html[5])], "page_id long, url string, html string")
    write_warc(pages, f"{tmp_path}/w", segment_bytes=500)
    records = read_warc(spark, f"{tmp_path}/w")
    whole = {bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect()}
    assert whole == {h or "" for h in html}
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in page_digest(records).collect())
    assert got == [(0, 4, "revisit", 1), (1, 4, "response", None), (2, 0, "revisit", 3), (3, 0, "response", None),
                   (4, len(html[4].encode()), "response", None), (5, 20_000, "response", None), (5, 20_000, "response", None)]


def test_missing_segment_stops(spark, tmp_path):
    from helio_spark.llm.warc import page_records

    records = page_records(1, "u", b"z" * 5000, None, False, 1000, 100)
    assert len(list(parse(b"".join(r + b"\r\n\r\n" for r in records)))) == len(records) > 3
    (tmp_path / "part-0").write_bytes(b"".join(r + b"\r\n\r\n" for i, r in enumerate(records) if i != 2))
    with pytest.raises(Exception, match="segments of .* are missing"):
        read_warc(spark, str(tmp_path)).collect()


def test_codewords_are_far_apart():
    for n in (2, 4, 5, 40):
        code = language.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else code.shape[1] // 4)


def test_classifiers_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = QUERIES["op5_quality"](spark, sf).join(labels, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    got = QUERIES["op6_toxicity"](spark, sf).join(labels, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.9
    got = QUERIES["op8_language"](spark, sf).join(docs, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_neighbours_are_exact():
    import numpy as np

    rng = np.random.default_rng(5)
    index = toxicity.Index([(int(t), str(t)) for t in range(30)], 100, np.ones(30))
    rows = []
    for _ in range(400):
        v = {int(t): float(rng.random()) for t in rng.choice(30, rng.integers(1, 6), replace=False)}
        norm = sum(w * w for w in v.values()) ** 0.5
        rows.append({t: w / norm for t, w in v.items()})
    index.add(list(range(400)), rows, [float(i % 2) for i in range(400)])
    placed = {i: rows[doc] for i, doc in enumerate(index.ids)}
    for q in rows[:40]:
        best = sorted((sum(w * v.get(t, 0) for t, w in q.items()) for v in placed.values()), reverse=True)[: index.k]
        assert [round(s, 9) for s, _ in index.nearest(q)] == [round(s, 9) for s in best]


def test_words_of_the_mix(spark):
    got = mix(odd_docs(spark)).collect()
    texts = {r.doc_id: r.text for r in odd_docs(spark).collect()}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 700):
        a = rng.integers(-(2**63), 2**63 - 1, n)
        b = np.concatenate([a[: n * 3 // 4], rng.integers(-(2**63), 2**63 - 1, n // 4 + 1)])
        x, y = parity_of(a), parity_of(b)
        assert len(x) == PARITY // 64
        distance = sum(int(u ^ v).bit_count() for u, v in zip(x.view(np.uint64), y.view(np.uint64)))
        assert distance <= len(set(a.tolist()) ^ set(b.tolist()))
        assert parity_of(rng.permutation(a)).tolist() == x.tolist()


def test_lines_are_cut_once_a_pass(spark):
    # a filter on the words was pushed below them, so that each line was cut twice
    text = [" Same words in every Line\nan own line with the number 0 in it", "same words in every line\t\ntwo words\n \n", None, "a b c a b c a b c a b c"]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").repartition(2)
    keyed = line_dedup._keyed(docs, "doc_id", "text")
    tokens, ranks = line_dedup._with_tokens(keyed), line_dedup._ranks(keyed)
    plan = line_dedup._postings(tokens, ranks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1
    # the table counts each token of the lines, as often as a line has it
    words = [w for t in text if t for line in t.split("\n") if (w := line.lower().split())]
    count = collections.Counter(tuple(w[i : i + 5]) for w in words for i in range(max(len(w) - 4, 1)))
    hashed = spark.createDataFrame([(list(t), n) for t, n in count.items()], "t array<string>, n int")
    slot = F.pmod(F.xxhash64(F.transform("t", lambda w: F.xxhash64(w))), F.lit(line_dedup.COUNTS))
    slots = {r.slot: r.n for r in hashed.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).collect()}
    places = spark.range(1).select(ranks.alias("r")).first().r
    order = sorted(slots, key=lambda s: (slots[s], s))
    assert len(order) > 5 and [places[s] >> 48 for s in order] == list(range(len(order)))


def test_tokens_of_two_lines_that_cannot_match_are_left_out(spark):
    # (token, text, size of its set, place in it): each such token was kept, and its lines were cut, sent and compared
    rows = [
        (1, 10, 8, 0), (1, 11, 20, 0),  # of unlike sizes
        (2, 12, 8, 1), (2, 13, 8, 1),  # seven tokens may be shared: enough
        (3, 12, 8, 2), (3, 13, 8, 2),  # six are not
        (4, 14, 8, 0), (4, 14, 8, 0),  # one text twice
        (5, 15, 8, 0), (5, 15, 8, 0), (5, 16, 8, 0), (6, 17, 3, 0),
    ]
    postings = spark.createDataFrame(rows, "token long, h1 long, n int, i int").repartition(3)
    got = sorted((r.token, r.h1, r.many) for r in line_dedup._shared(postings).collect())
    assert got == [(2, 12, False), (2, 13, False), (5, 15, True), (5, 16, True)]
    # numbers that cannot be null are sorted as such; pairs of lines are stored, so that they are made once
    docs = spark.createDataFrame([(1, "a b c d e f\tg\x0bh  i\rj\x0ck"), (2, "A B C D E F G H I J K")], "doc_id long, text string")
    keyed = line_dedup._keyed(docs, "doc_id", "text")
    ordered = line_dedup._postings(line_dedup._with_tokens(keyed), line_dedup._ranks(keyed))
    assert not ordered.schema["token"].nullable
    assert sorted(r.n_removed for r in dedup_lines(docs).collect()) == [0, 1]
