"""Benchmark passages against a plain search for every window."""

from __future__ import annotations

import random
import re

import pytest

from tidemark.llm import decontamination as D

LOWER = {k: chr(k + 32) for k in range(65, 91)}


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((doc if doc is not None else -1, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out)


def tables():
    rng = random.Random(1)
    word = lambda: rng.choice(["The", "CAT", "né", "É", "x1", "日本", "of", "a", f"w{rng.randrange(40)}"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9, 10, 11, 25])))) for k in range(30)]
    items += [(100, items[5][1]), (101, ""), (102, None), (None, "solitary words of no item"), (7, "one more text under seven")]
    docs = []
    for k in range(120):
        parts = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split()
            at, cut = rng.randrange(len(parts) + 1), rng.randrange(4)
            parts[at:at] = own[cut:] if rng.random() < 0.4 else own
        docs.append((k, rng.choice([" ", ", ", "\n", "_"]).join(parts)))
    long = " ".join(word() for _ in range(5000)) + " " + items[7][1]
    return docs + [(200, None), (201, ""), (3, docs[3][1]), (None, "Solitary, words of NO item!"), (None, None), (202, long)], items


@pytest.mark.parametrize("broadcast", [D.BROADCAST, 0])
def test_against_plain_search(spark, monkeypatch, broadcast):
    """With the windows sent to the texts, and with shingles shuffled to the windows."""
    monkeypatch.setattr(D, "BROADCAST", broadcast)
    docs, items = tables()
    own = spark.createDataFrame(docs, "doc_id LONG, text STRING").selectExpr("*", "1 AS item_id", "2 AS h", "3 AS `a.b`", "4 AS words")
    bench = spark.createDataFrame(items, "item_id LONG, text STRING").selectExpr("*", "5 AS doc_id", "6 AS n")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"], r.contaminated) for r in D.contaminated(own, bench).collect())
    assert got == brute(docs, items)
    assert sum(r[4] for r in got) > 30


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id LONG, text STRING"), spark.createDataFrame([], "item_id LONG, text STRING")
    assert [tuple(r) for r in D.contaminated(docs, items).collect()] == [(1, 2, 0, 0, [], False)]
    assert D.contaminated(docs.limit(0), items).collect() == []
    assert D.contaminated(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id LONG, text STRING")).collect() == []
