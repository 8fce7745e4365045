"""Tokenizer alignment against the libraries on whole texts and all pairs of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import token_links as L

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts():
    rng = random.Random(5)
    parts = ["the", "Thesened", "año", "schön", "x", "42", "3.14", ",", ".", ");", "\r", "\n", "\n\n", "\t", " ", "  ", "   ", "'s", "don't", "日本語", "🙂", "é", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "_", "__", " ", "\x1c", "　", "-->", "Ünï"]
    out = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    return out + ["the cat", "the cat", "the dog", "", None, " ", "  ", "\n", "▁", "a ▁ b", " lead", "tail ", "a\tb", "word\t\n", "x" * 5000, "ab" * 3000 + " the", "日本" * 1500, "q7Z" * 2000]


def brute(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    aligner = L.Aligner(A, B)
    found = []
    for text in rows:
        whole = (" " + (text or "")).encode()
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        p, q = ([t[k] for k in ids] for ids, t in ((x, aligner.a_bytes), (y, aligner.b_bytes)))
        if b"".join(p) != whole or b"".join(q) != whole:
            found.append((0, 0, [], []))
            continue
        ends = []
        for own in (p, q):
            at, e = 0, []
            for piece in own:
                at += len(piece)
                e.append(at)
            ends.append(e)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            groups.append(tuple([k for k, e in zip(ids, own, strict=True) if low < e <= high] for ids, own in ((x, ends[0]), (y, ends[1]))))
        found.append((len(x), len(y), groups, [(i, j) for g in groups for i in g[0] for j in g[1]]))
    counts = Counter(pair for f in found for pair in set(f[3]))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for n_a, n_b, groups, links in found:
        shown = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        best = sum(counts[k] == most[k[0]] for k in links)
        out.append((n_a, n_b, len(groups), len(links), best, sum(counts[k] for k in links), hashlib.sha256(shown.encode()).hexdigest() if n_a else ""))
    return out


@pytest.mark.parametrize("hot", [L.HOT, 40, 0])
def test_against_libraries(spark, monkeypatch, hot):
    """With all pairs on the executors, a few of them, and none."""
    monkeypatch.setattr(L, "HOT", hot)
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id LONG, text STRING").selectExpr("*", "1 AS pair", "2 AS row", "3 AS `a.b`")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in L.scored(docs, A, B).collect()}
    want = brute(rows)
    assert [k for k in range(len(rows)) if got[k] != want[k]] == []


def test_ranks_of_shared_cuts():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(1, 60))), n)) for _ in range(2))
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        x, y = L.rank_groups(a, b, n)
        assert (x.tolist(), y.tolist()) == ([sum(a <= c) for c in cuts], [sum(b <= c) for c in cuts])


def test_giant_groups_and_small_parts(spark, monkeypatch):
    """Groups whose links are counted by distinct ids, texts in parts of a few bytes, and a cache that turns over all the time."""
    for name, value in (("GIANT", 1), ("BYTES", 50), ("CACHE", 5)):
        monkeypatch.setattr(L, name, value)
    rows = texts()[:60] + ["", None, "日本" * 300]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id LONG, text STRING")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in L.scored(docs, A, B).collect()}
    assert [got[k] for k in range(len(rows))] == brute(rows)


def test_groups_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "the cat"), (1, None)], "doc_id LONG, text STRING")
    rows = {r.doc_id: r for r in L.aligned(docs, A, B).collect()}
    aligner = L.Aligner(A, B)
    assert rows[None].groups == ";".join(f"{a}|{b}" for a, b in zip(aligner.a_ids(" the") + aligner.a_ids(" cat"), sum(aligner.b_ids([" the", " cat"]), []), strict=True))
    assert len(rows[None].pairs) == 2
    assert rows[1].groups == "" and rows[1].groups_sha256 == "" and rows[1].n_links == 0
    assert L.scored(docs.limit(0), A, B).collect() == []
