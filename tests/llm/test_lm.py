"""Context-tree weighting against a plain recursive model; base scores against their definition."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from tidemark.llm import ctw, lm_scoring

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


class SlowTree:
    """The definition, node by node."""

    def __init__(self, texts, depth):
        self.depth, self.seen = depth, {}
        for text in texts:
            data = b"\n" * depth + ctw.stream(text)
            for t in range(depth, len(data)):
                for b in range(8):
                    node, bit = (1 << b) | (data[t] >> (8 - b)), data[t] >> (7 - b) & 1
                    for d in range(depth + 1):
                        self.seen.setdefault((node, data[t - d : t]), [0, 0])[bit] += 1
        self.children = {}
        for node, context in self.seen:
            if context:
                self.children.setdefault((node, context[1:]), []).append(context)

    @cache
    def pe(self, node, context):
        a, b = self.seen[node, context]
        half = lambda k: math.lgamma(k + 0.5) - math.lgamma(0.5)
        return half(a) + half(b) - math.lgamma(a + b + 1)

    @cache
    def pw(self, node, context):
        own = self.pe(node, context)
        if len(context) == self.depth:
            return own
        return float(np.logaddexp(own, sum(self.pw(node, c) for c in self.children[node, context]))) - math.log(2)

    def one(self, node, context):
        done, rest = 0.0, 1.0
        if (node, b"") not in self.seen:
            return 0.5
        for d in range(self.depth + 1):
            here = context[len(context) - d :]
            a, b = self.seen[node, here]
            kt = (b + 0.5) / (a + b + 1)
            deeper = context[len(context) - d - 1 :] if d < self.depth else None
            if deeper is None or (node, deeper) not in self.seen:
                return done + rest * kt
            stop = math.exp(self.pe(node, here) - math.log(2) - self.pw(node, here))
            done, rest = done + rest * stop * kt, rest * (1 - stop)

    def score(self, text):
        data, total = b"\n" * self.depth + ctw.stream(text), 0.0
        for t in range(self.depth, len(data)):
            for b in range(8):
                p = self.one((1 << b) | (data[t] >> (8 - b)), data[t - self.depth : t])
                total += math.log10(p if data[t] >> (7 - b) & 1 else 1 - p)
        return total


def corpus():
    rng = random.Random(2)
    words = ["the", "then", "éa", "tion", "A", "b,", "x" * 9, "the end"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    return [*texts, None, "", "unseen wörds 12 \t\n zq", "q" * 3000]


@pytest.mark.parametrize("part", [3_000_000, 100])
def test_scores(spark, part, monkeypatch):
    texts = corpus()
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "the b,")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).selectExpr("*", "1 AS n", "2 AS key", "3 AS score", "4 AS row")
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [(t or "").encode() for i, t in rows if not out(i)]
    tree = SlowTree(train, 3)
    seen = Counter(w for t in train for w in [*t.lower().split(), b"\n"])
    N, V = sum(seen.values()), len(seen)
    model = lm_scoring.LanguageModel(docs.filter(~lm_scoring.held_out()), depth=3, part=part)
    assert (len(model.parts) > 1) == (part == 100)
    got = lm_scoring.score(docs, model).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        own = [*(t or "").encode().lower().split(), b"\n"]
        want[i] = (out(i), len(own), sum(w in seen for w in own), N, sum(math.log10((seen[w] + 0.1) / (N + 0.1 * (V + 1))) for w in own), tree.score((t or "").encode()))
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4]) and r.score == pytest.approx(w[5], rel=1e-5)
    bytes_ = {i: len(ctw.stream((t or "").encode())) for i, t in rows}
    assert all(r.bits_per_byte == pytest.approx(-want[r.doc_id][5] * math.log2(10) / bytes_[r.doc_id], rel=1e-5) for r in got)
    # Texts are scored in chunks; one longer than a chunk is scored whole.
    monkeypatch.setattr(lm_scoring, "CHUNK", 64)
    again = {r.doc_id: r.score for r in lm_scoring.score(docs, model).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in got)


def test_nothing_trained(spark):
    docs = spark.createDataFrame([(0, "ab", None, None, None)], DOCS)
    model = lm_scoring.LanguageModel(docs.limit(0))
    (r,) = lm_scoring.score(docs, model).collect()
    assert r.score == pytest.approx(24 * math.log10(0.5)) and r.n_known == 0
    assert lm_scoring.score(docs.limit(0), model).collect() == []


def test_kt_tables():
    k = np.array([0, 1, 5, 70_000, 10**9])
    assert ctw._half(k) == pytest.approx([math.lgamma(x + 0.5) - math.lgamma(0.5) for x in k.tolist()], rel=1e-12)
    assert ctw._whole(k) == pytest.approx([math.lgamma(x + 1) for x in k.tolist()], rel=1e-12)
