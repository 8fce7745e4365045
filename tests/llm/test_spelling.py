"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
import regex

from tidemark.llm import spelling as S


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    counts = Counter()
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form.get(w) or "", n.get(form.get(w)) or 0, root(w)) for w in n)


def rows(seed, letters, stems, size):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(stems)]
    for w in list(words):
        for _ in range(3):
            k, c = rng.randrange(len(w)), rng.choice(letters)
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w + c, c + w]))
    words += ["Größer", "größer", "ÀÉÎõü", "a" * 300, "a" * 301, "aaaaa", "aaaaaa", "aaaaab", "baaaaa"]
    return [(k, " ".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "1"]) for _ in range(60))) for k in range(size)] + [(None, "hello hello hello hallo"), (5, None), (6, ""), (7, "hallo hallo hello x")]


@pytest.mark.parametrize("limit,group", [(S.LIMIT, S.GROUP), (1, 7), (5, 3), (30, 40)])
def test_against_all_pairs(spark, monkeypatch, limit, group):
    """With the trie whole, cut down to single words, and between."""
    monkeypatch.setattr(S, "LIMIT", limit)
    monkeypatch.setattr(S, "GROUP", group)
    own = rows(limit, "ab", 60, 120) if limit != 30 else rows(3, "abcdé", 100, 150)
    if limit == 1:
        own = [(k, t.replace("a" * 300, "a" * 30).replace("a" * 301, "a" * 31)) for k, t in ((k, t or "") for k, t in own)]
    docs = spark.createDataFrame(own, "doc_id LONG, text STRING").selectExpr("*", "1 AS word", "2 AS n", "3 AS `a.b`")
    got = sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in S.variants(docs).collect())
    assert got == brute(own)


def test_walk_finds_each_pair_once():
    rng = random.Random(9)
    for _ in range(40):
        words = sorted({"xy" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(60)})
        pairs = [tuple(sorted(p)) for p in S.walk(words, [2] * len(words)).tolist()]
        want = sorted((i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if distance_one(words[i], words[j]))
        assert sorted(pairs) == want


def test_empty_table(spark):
    assert S.variants(spark.createDataFrame([], "doc_id LONG, text STRING")).collect() == []
