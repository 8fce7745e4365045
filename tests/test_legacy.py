"""Cuts taken in turn against the loop."""

from __future__ import annotations

import random

from tidemark.operators import legacy as G


def looped(boards, cuts):
    taken, moved = [], None
    for k, (start, _) in enumerate(boards):
        start = moved if moved is not None else start
        after = boards[k + 1][1] if k + 1 < len(boards) else None
        good = cuts[k] is not None and after is not None and start + 0.05 < cuts[k] < after - 0.05
        taken.append(good)
        moved = round(cuts[k], 3) if good else None
    return taken


def test_cuts_taken_in_turn(spark):
    """Chapters where a cut taken hinders the next, the next helps, or nothing depends; one of 50,000 boards."""
    rng = random.Random(3)
    chapters = {c: [(0.1 * k, 0.1 * k + rng.uniform(0.02, 0.4)) for k in range(n)] for c, n in enumerate([1, 2, 3, 5, *[40] * 20, 50_000])}
    cuts = {c: [rng.choice([None, 0.1 * k + rng.choice([0.04, 0.06, 0.1, 0.15, 0.2, 0.3])]) if rng.random() < 0.95 else None for k in range(len(own) - 1)] + [None] for c, own in chapters.items()}
    boards = spark.createDataFrame([(c, k, s, e) for c, own in chapters.items() for k, (s, e) in enumerate(own)], "chapter_num LONG, idx INT, start_time DOUBLE, end_time DOUBLE")
    points = spark.createDataFrame([(c, k, x, "silence") for c, own in cuts.items() for k, x in enumerate(own) if x is not None], "chapter_num LONG, point_id INT, cut DOUBLE, method STRING")
    got = {}
    for r in G.applied(boards, points).select("chapter_num", "idx", "cut_taken").collect():
        got.setdefault(r.chapter_num, {})[r.idx] = r.cut_taken
    for c, own in chapters.items():
        assert [got[c][k] for k in range(len(own))] == looped(own, cuts[c])
