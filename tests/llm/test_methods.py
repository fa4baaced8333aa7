"""Anchors, neighbours and decoding by plain loops that share no code with the operators."""

from __future__ import annotations

import math
import random

import numpy as np

from helio_spark.llm import language, quality, syncmers

MASK = 2**64 - 1


def spread64(x):
    """The published splitmix finaliser."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_hash(text):
    total = 0
    for c in reversed(text):
        total = (total * syncmers._BASE + spread64(ord(c) + 1)) & MASK
    return spread64(total)


def plain_anchors(text, k, s):
    """Closed syncmers: the least s-mer of a k-mer is its first or last. A text without any is one anchor."""
    out = []
    for i in range(len(text) - k + 1):
        inner = [plain_hash(text[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, plain_hash(text[i : i + k])))
    return out or ([(0, plain_hash(text))] if text else [])


def test_anchors_by_loop():
    rng = random.Random(1)
    alphabets = ["ab", "abcdefghij ", "aé€\U0001f600 ", "x"]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (0, 1, 5, syncmers.K - 1, syncmers.K, 40, 300)]
    got = syncmers.text_anchors(texts)
    for text, (at, value) in zip(texts, got):
        assert list(zip(at.tolist(), value.tolist())) == plain_anchors(text, syncmers.K, syncmers.S)


def test_fingerprint_is_the_least_anchors(spark):
    texts = ["one two three four five six seven eight " * 20, "".join(random.Random(i).choice("abcdef ") for i in range(900)), "ab", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in syncmers.fingerprints(docs).collect():
        least = sorted({h >> 32 for _, h in plain_anchors(texts[r.doc_id], syncmers.K, syncmers.S)})[: syncmers.SIZE]
        assert r.fingerprint == "".join(f"{h:08x}" for h in least)


def test_votes_of_the_nearest_by_full_sort():
    rng = np.random.default_rng(2)
    x = rng.random((300, 60)).astype(np.float32)
    label = (rng.random(300) < 0.4).astype(float)
    voters = quality.Voters(x.copy(), label, latent=8, neighbours=15)
    texts = rng.random((40, 60)).astype(np.float32)
    got = voters.scores(texts)
    unit = lambda v: v / max(1e-9, math.sqrt(sum(float(a) ** 2 for a in v)))
    for row, score in zip(texts, got):
        y = unit((row * voters.weight - voters.centre) @ voters.axes)
        cosine = sorted(((float(np.dot(y, v)), i) for i, v in enumerate(voters.vectors)), reverse=True)[:15]
        weight = [max(c, 1e-6) ** 2 for c, _ in cosine]
        assert score == np.float64(sum(w * label[i] for w, (_, i) in zip(weight, cosine)) / sum(weight)) or abs(
            score - sum(w * label[i] for w, (_, i) in zip(weight, cosine)) / sum(weight)
        ) < 1e-5


def test_decoding_by_loop_over_codewords():
    rng = np.random.default_rng(4)
    names = np.array(["de", "en", "fr", "it", "pt", "xx"])
    lang = names[rng.integers(0, 6, 400)]
    centre = {n: rng.random(32) for n in names}
    x = np.stack([centre[n] + 0.3 * rng.random(32) for n in lang]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language.Model(x, lang)
    losses = model.losses(x[:50])
    right = 0
    for row, own, told in zip(x[:50], losses, lang[:50]):
        margin = [float(np.dot(row, model.w[:-1, b]) + model.w[-1, b]) for b in range(model.code.shape[1])]
        plain = [sum(t * math.log1p(math.exp(-4 * m * bit)) for t, m, bit in zip(model.trust, margin, word)) for word in model.code]
        assert np.allclose(own, plain, atol=1e-4)
        assert int(np.argmin(own)) == plain.index(min(plain)) or abs(min(plain) - sorted(plain)[1]) < 1e-4
        right += model.languages[int(np.argmin(own))] == told
    assert right >= 45
    apart = [sum(a != b for a, b in zip(u, v)) for i, u in enumerate(model.code) for v in model.code[:i]]
    assert min(apart) >= 5
