"""Fingerprints, covering tables and components against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, simhash

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def slow_fingerprint(text, size=3):
    words = [w for w in "".join(c if c in "\t\n\x0b\x0c\r " or not c.isspace() else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    parts = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_fingerprints():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 4, 50, 1500]:
        text = " ".join(rng.choice(["The", "É", "cat", " x", "SAT"]) + str(rng.randrange(9)) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_cover_is_complete():
    """Any difference of up to three bits is left out by some table."""
    masks = simhash.cover(list(range(64)), 3)
    assert len(masks) == 15
    for k in (1, 2, 3):
        for bits in random.Random(k).sample(list(combinations(range(64), k)), 64):
            assert any(not sum(1 << b for b in bits) & m for m in masks)
    free = list(range(0, 40, 5))
    for bits in combinations(free, 3):
        assert any(not sum(1 << b for b in bits) & m for m in simhash.cover(free, 3))


@pytest.mark.parametrize("bucket", [256, 40])
def test_links_and_components(spark, bucket):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base[:6]:
        for _ in range(30):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64 if b != base[0] else 7)
            fps.add(x)
    fps = sorted(fps)
    signed = [simhash._signed(x) for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp LONG")
    got = {r.node: r.component for r in components.components(simhash.links(table, 3, bucket)).collect()}
    near = [(simhash._signed(a), simhash._signed(b)) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    want = union_find(signed, near)
    assert {n: got.get(n, n) for n in signed} == want


def test_components_of_paths(spark):
    rng = random.Random(1)
    order = rng.sample(range(80), 80)
    pairs = list(zip(order, order[1:50])) + [(order[60], k) for k in order[61:]] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()}
    want = union_find(range(80), pairs)
    assert got == {n: want[n] for n in got} and set(got) == {x for a, b in pairs if a != b for x in (a, b)}


def test_classes(spark):
    words = [f"w{k}" for k in range(400)]
    near = [*words[:200], "other", *words[201:]]
    texts = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (2, None), (7, " \n"), (8, "a b"), (8, "a b"), (None, "alone one two"), (1, "z " * 50)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOCS).withColumn("fp", F.lit("clash"))
    got = simhash.classes(docs).collect()
    fps = {i: slow_fingerprint(t) for i, t in texts}
    want = union_find([5, 3, 9, 2, 7, 8, 1], [(a, b) for a, b in combinations([5, 3, 9, 2, 7, 8, 1], 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp, r.component_id) == (simhash._signed(fps[r.doc_id]), want[r.doc_id])
    assert want[3] == want[5] == want[9] == 3 and want[7] == 2
    assert simhash.classes(docs.limit(0)).collect() == []


def test_dense_cluster(spark):
    """A cluster of 20,000 distinct fingerprints is one component, dealt over many tasks and not copied level by level."""
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = [simhash._signed(base ^ k) for k in rng.sample(range(1 << 15), 20_000)]
    far = [simhash._signed(base ^ (rng.getrandbits(30) << 20)) for _ in range(50)]
    table = spark.createDataFrame([(x,) for x in dict.fromkeys(fps + far)], "fp LONG")
    got = components.components(simhash.links(table)).filter(F.col("node").isin(fps[:2000])).groupBy("component").count().collect()
    assert [r["count"] for r in got] == [2000]
