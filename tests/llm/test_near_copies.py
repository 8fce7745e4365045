"""Near copies of the pipeline against every pair's overlap of five-word shingles."""

from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline
from tidemark.llm import near_copies

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def overlap(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def texts():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(30):  # copies at overlaps around the limit, in chains
        own = [word() for _ in range(300)]
        out.append(own)
        for _ in range(3):
            own = list(own)
            for k in rng.sample(range(0, 300, 10), rng.choice([2, 4, 6, 7, 8, 10])):
                own[k] = word()
            out.append(own)
    passage = [word() for _ in range(60)]
    out += [[*passage, *(word() for _ in range(40))] for _ in range(40)]  # a shared passage, below the limit
    hot = [word() for _ in range(150)]
    for _ in range(60):  # a large group of near copies
        own = list(hot)
        own[rng.randrange(150)] = word()
        out.append(own)
    out += [[word() for _ in range(4)] for _ in range(300)]  # short ones
    return [" ".join(t) for t in out] + ["", None, " \n", "One two", "one  TWO"]


def expected(all_texts):
    up = list(range(len(all_texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(all_texts)), 2):
        if overlap(all_texts[a], all_texts[b]) >= 0.8:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return [k for k in range(len(up)) if up[k] == k]


def test_stage_keeps_one_of_each_component(spark):
    rows = texts()
    docs = spark.createDataFrame([(k, t, "en", "src0", 0) for k, t in enumerate(rows)], DOCS)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == expected(rows)


def test_pairs_left_in_a_bucket_are_compared(spark, monkeypatch):
    """Where all sets meet in one bucket, the links must still be found, by rounds of centers or at once."""
    monkeypatch.setattr(near_copies, "prefix", lambda hashes, levels: hashes[:1] * 0)
    monkeypatch.setattr(near_copies, "CENTERS", 3)
    monkeypatch.setattr(near_copies, "by_fingerprint", lambda links: links.check(spark.createDataFrame([], "a LONG, b LONG")))
    rows = texts()[:60]
    docs = spark.createDataFrame([(k, t, "en", "src0", 0) for k, t in enumerate(rows)], DOCS)
    for rounds, few in ((0, 0), (3, 0), (3, 100)):
        monkeypatch.setattr(near_copies, "ROUNDS", rounds)
        monkeypatch.setattr(near_copies, "FEW", few)
        assert sorted(r.doc_id for r in near_copies.deduplicate(docs).collect()) == expected(rows)


def test_prefixes_meet_in_reach():
    """Any two sets that overlap by 0.8 share a shingle of their prefixes, whose place lets the pair through."""
    import numpy as np

    rng = np.random.default_rng(3)
    levels = rng.integers(0, 20, near_copies.SLOTS).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 9 * common >= 4 * (len(a) + len(b)):
            x, y = near_copies.prefix(a, levels).tolist(), near_copies.prefix(b, levels).tolist()
            i = next(k for k, h in enumerate(x) if h in y)
            j = y.index(x[i])
            assert 9 * min(len(a) - i, len(b) - j) >= 4 * (len(a) + len(b))
            last = min(x[-1], y[-1])
            p, q = {k for k in x if k <= last}, {k for k in y if k <= last}
            most = len(p & q) + min(len(a) - len(p), len(b) - len(q))
            assert common <= most and 9 * most >= 4 * (len(a) + len(b))


def test_awkward_columns(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (None, None), (None, ""), (7, "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("*", "1 AS mark", "2 AS node", "3 AS doc", "4 AS `a.b`", "5 AS __mark")
    got = near_copies.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.mark, r.node, r.doc, r[5], r[6]) for r in got.collect()) == [(0, 1, 2, 3, 4, 5)] * 2 + [(1, 1, 2, 3, 4, 5), (7, 1, 2, 3, 4, 5)]
    assert near_copies.deduplicate(docs.limit(0)).collect() == []


def test_limit_is_exact(spark):
    for n, m, same, linked in [(9, 8, 8, True), (10, 8, 8, True), (10, 7, 7, False), (9, 9, 9, True), (9, 9, 8, True), (9, 9, 7, False), (1, 1, 0, False)]:
        a, b = list(range(n)), [*range(same), *range(100, 100 + m - same)]
        row = spark.createDataFrame([(a, b)], "a ARRAY<LONG>, b ARRAY<LONG>").select(near_copies.alike("a", "b").alias("x")).first()
        assert row.x == linked == (10 * same >= 8 * (n + m - same))


def test_a_large_group_costs_rows_by_its_size(spark, monkeypatch):
    """Near copies in one bucket: pairs that are made, and rows that are kept of links, grow with their number, not its square."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = [" ".join([*base, f"x{k}"]) for k in range(120)]
    made, kept, check = [], [], near_copies.Links.check

    def counted(self, pairs):
        made.append(pairs.count())
        check(self, pairs)
        kept.append(self.found.count())

    monkeypatch.setattr(near_copies.Links, "check", counted)
    monkeypatch.setattr(near_copies, "by_fingerprint", lambda links: links.check(spark.createDataFrame([], "a LONG, b LONG")))
    docs = spark.createDataFrame([(k, t, "en", "src0", 0) for k, t in enumerate(rows)], DOCS)
    assert [r.doc_id for r in near_copies.deduplicate(docs).collect()] == [0]
    assert sum(made) < 2 * 3 * near_copies.CENTERS * len(rows) and max(kept) <= len(rows)


def test_maps_let_near_sets_through(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    cases = []
    for n in (1, 5, 40, 300, 2000):
        for gone in (0, n // 20, n // 9, n // 4):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64)]))
            near = 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
            cases.append((near_copies.bitmap(a).tolist(), len(a), near_copies.bitmap(b).tolist(), len(b), bool(near), n))
    rows = spark.createDataFrame(cases, "a ARRAY<LONG>, m LONG, b ARRAY<LONG>, n LONG, near BOOLEAN, size LONG")
    got = rows.select(near_copies.maps_allow("a", "m", "b", "n").alias("allowed"), "near", "size").collect()
    assert all(r.allowed for r in got if r.near) and any(not r.allowed for r in got if not r.near and r.size == 300)
