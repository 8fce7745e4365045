"""Scans in stretches against plain windows and loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators import signal as G
from tidemark.operators.scans import Scan, numbered, scanned

def scans():
    v = F.col("v")
    how = ("total", "highest", "last", "ahead")
    return {f"{h}_{own}": Scan(v, h, own) for h in how for own in (True, False)}


def test_scans_equal_windows(spark):
    """One level and two, null values, a null key, sequences of one row and of many, places with gaps, columns with clashing names."""
    rng = random.Random(5)
    rows = []
    for key, n in [(None, 30), (1, 1), (2, 700), (3, 40)]:
        places = sorted(rng.sample(range(3 * n), n))
        rows += [(key, at, rng.choice([None, None, rng.randint(-9, 9)]), "x") for at in places]
    df = spark.createDataFrame(rows, "k INT, at INT, v LONG, _scanlevel0 STRING")
    want = sorted(map(tuple, scanned(df, ["k"], ["at"], [], scans()).collect()), key=repr)
    for levels in ([F.floor(F.col("at") / 10)], [F.floor(F.col("at") / 7), F.floor(F.col("at") / 70), F.floor(F.col("at") / 700)], [F.lit(None).cast("long")], [F.col("at")]):
        got = scanned(df, ["k"], ["at"], levels, scans())
        assert got.columns == scanned(df, ["k"], ["at"], [], scans()).columns
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert scanned(df.limit(0), ["k"], ["at"], [F.floor(F.col("at") / 10)], scans()).count() == 0


def test_long_sequence_is_spread(spark):
    """One sequence of a million rows: every window over its rows is partitioned by stretch, and no task holds all of it."""
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    out = numbered(df, ["k"], ["at"], [F.floor(F.col("at") / 10_000)], "n").withColumn("part", F.spark_partition_id())
    assert out.filter("n <> at").count() == 0
    sizes = [r["count"] for r in out.groupBy("part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 700_000


def test_islands_across_stretches(spark, monkeypatch):
    """Runs inside a stretch, over its borders, over several stretches; as a loop finds them."""
    monkeypatch.setattr(G, "STRETCH", 8)
    rng = random.Random(7)
    chapters = {c: [rng.random() < share for _ in range(n)] for c, (n, share) in enumerate([(1, 1), (8, 1), (64, 1), (65, 1), (200, 0.9), (200, 0.5), (9, 0), (333, 0.97)])}
    rows = spark.createDataFrame([(c, k, 0.01 if q else 0.5) for c, own in chapters.items() for k, q in enumerate(own)], "chapter_num INT, frame_idx INT, rms FLOAT")
    stats = spark.createDataFrame([(c, 0.1) for c in chapters], "chapter_num INT, threshold DOUBLE")
    want = set()
    for c, own in chapters.items():
        start = None
        for k, q in enumerate([*own, False]):
            if q and start is None:
                start = k
            elif not q and start is not None:
                want.add((c, start, k))
                start = None
    got = G.quiet_islands(rows, stats).select("chapter_num", "first_frame", "end_frame").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
