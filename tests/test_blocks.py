"""Matching blocks by joins against the recursion over whole sequences."""

from __future__ import annotations

import difflib
import random

import pyarrow as pa
import pytest

from tidemark.operators import alignment as A
from tidemark.operators import blocks as B


def sequences(seed):
    rng = random.Random(seed)
    out = []
    for chapter in range(12):
        letters = "abcdefghij"[: rng.choice([2, 4, 10])]
        book = [rng.choice(letters) for _ in range(rng.randrange(90))]
        heard = list(book)
        for _ in range(rng.randrange(12)):
            k, n = rng.randrange(len(heard) + 1), rng.randrange(6)
            heard[k : k + rng.randrange(6)] = [rng.choice(letters + "xyz") for _ in range(n)]
        if chapter % 4 == 3:
            heard = heard[len(heard) // 2 :] + heard[: len(heard) // 2]
        out.append((book, heard))
    return out + [([], ["a"]), (["a"], []), (["a"] * 40, ["a"] * 30), (list("abcdefgh"), list("hgfedcba"))]


@pytest.mark.parametrize("gap,stretch,grams", [(B.GAP, B.STRETCH, B.GRAMS), (40, 8, (16, 4, 2)), (4, 8, (8, 4, 2)), (1, 3, (5, 2)), (0, 16, (2,))])
def test_blocks_are_those_of_the_recursion(spark, monkeypatch, gap, stretch, grams):
    for name, value in (("GAP", gap), ("STRETCH", stretch), ("GRAMS", grams)):
        monkeypatch.setattr(B, name, value)
    own = sequences(gap)
    rows = lambda side: [(c, 3 * k + c, w) for c, pair in enumerate(own) for k, w in enumerate(pair[side])]
    book = spark.createDataFrame(rows(0), "chapter_num LONG, token_idx INT, norm STRING")
    heard = spark.createDataFrame(rows(1), "chapter_num LONG, heard_idx INT, norm STRING")
    got = sorted((r.chapter_num, (r.token_idx - r.chapter_num) // 3, (r.heard_idx - r.chapter_num) // 3) for r in A.matches(book, heard, 2.0).collect())
    want = []
    for c, (text, said) in enumerate(own):
        for h, b, n in difflib.SequenceMatcher(None, said, text, autojunk=False).get_matching_blocks():
            want += [(c, b + k, h + k) for k in range(n)]
    assert got == sorted(want)


def test_a_long_chapter_with_fuzzy_words(spark):
    """One chapter of many thousand words: what is matched equals the function on the whole."""
    rng = random.Random(4)
    book = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.choice('aeiou')}{rng.randrange(30)}" for _ in range(6000)]
    heard = [w + "x" if k % 17 == 3 else w for k, w in enumerate(book) if k % 11 and not 2000 < k < 2400]
    frame = lambda ws, c: spark.createDataFrame([(7, k, w) for k, w in enumerate(ws)], f"chapter_num LONG, {c} INT, norm STRING")
    found = {r.token_idx: r.heard_idx for r in A.matches(frame(book, "token_idx"), frame(heard, "heard_idx")).collect()}
    right = [k for k in range(len(book)) if k % 11 and not 2000 < k < 2400]
    place = {k: n for n, k in enumerate(right)}
    assert sum(found.get(k) == place[k] for k in right) >= 0.99 * len(right)
    assert all(a < b for a, b in zip(*(lambda v: (v, v[1:]))([h for _, h in sorted(found.items())]), strict=False))


def test_regions_are_finished_one_at_a_time():
    """Words of many regions go by as a stream: pairs come out before later batches are asked for, also where a region spans batches."""
    rng = random.Random(5)
    regions = [(c, r, [rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abcd") for _ in range(rng.randrange(9))]) for c in range(40) for r in (0, 7)]
    rows = [(c, r, side, 2 * k + c, w) for c, r, *both in regions for side, ws in enumerate(both) for k, w in enumerate(ws)]
    asked = []

    def batches(size):
        for k in range(0, len(rows), size):
            asked.append(k)
            yield pa.RecordBatch.from_pylist([dict(zip(("chapter_num", "r", "side", "idx", "norm"), x, strict=True)) for x in rows[k : k + size]])

    want = [(c, 2 * h + c, 2 * b + c) for c, _, heard, book in regions for b, h in A.match_words(heard, book, 2.0).items()]
    for size in (1, 3, 50, 10_000):
        asked.clear()
        got, behind = [], []
        for batch in B.finished(batches(size), lambda said, text: A.match_words(said, text, 2.0)):
            got += [tuple(x.values()) for x in batch.to_pylist()]
            behind.append(len(asked))
        assert got == want
        assert size > 50 or behind[0] < len(asked) / 2
