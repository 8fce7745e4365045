"""Loudness envelopes, silences, and the questions asked of them.

Signals are rows ``chapter_num, samples``; envelopes are long tables ``chapter_num, frame_idx, rms``. Runs of
quiet frames are islands; whatever looks along the frames from some place meets the islands near it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import round3
from tidemark.operators.intervals import last_before, meeting, next_after
from tidemark.operators.scans import STRETCH

# Fixed values.
SEARCH, MIN_SILENCE, PROBE, SAFE = 0.70, 0.10, 0.6, 0.08
HEAD_PAD, TAIL_PAD = 0.25, 0.35


def frames(signals: DataFrame, hop: int) -> DataFrame:
    """Root mean squares of whole frames of ``hop`` samples."""
    n = F.floor(F.size("samples") / hop).cast("int")
    level = lambda k: F.sqrt(F.aggregate(F.slice("samples", k * hop + 1, F.lit(hop)), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / hop)
    values = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)), lambda k: level(k).cast("float"))
    return signals.select("chapter_num", F.posexplode(values).alias("frame_idx", "rms"))


def envelope_stats(frame_rows: DataFrame) -> DataFrame:
    """n_frames, noise_floor (5 %), speech_level (75 %) and the threshold between quiet and loud."""
    level = F.col("rms").cast("double")
    stats = frame_rows.groupBy("chapter_num").agg(
        F.count(F.lit(1)).cast("int").alias("n_frames"), F.percentile(level, F.lit(0.05)).alias("noise_floor"), F.percentile(level, F.lit(0.75)).alias("speech_level")
    )
    top = F.greatest(F.col("speech_level") * 0.35, F.lit(1e-4))
    raw = F.greatest(F.col("noise_floor") * 3, F.col("speech_level") * 0.06)
    return stats.withColumn("threshold", F.least(F.greatest(raw, F.lit(1e-4)), top))


def quiet_islands(frame_rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Maximal runs of quiet frames: first_frame, end_frame (exclusive).

    Found in stretches of ``STRETCH`` frames; the runs at their borders, two a stretch at most, are put together afterwards.
    """
    quiet = frame_rows.join(stats.select("chapter_num", "threshold"), "chapter_num").filter(F.col("rms") < F.col("threshold"))
    quiet = quiet.withColumn("stretch", F.floor(F.col("frame_idx") / STRETCH))
    order = Window.partitionBy("chapter_num", "stretch").orderBy("frame_idx")
    parts = (
        quiet.withColumn("run", F.col("frame_idx") - F.row_number().over(order)).groupBy("chapter_num", "stretch", "run")
        .agg(F.min("frame_idx").alias("first_frame"), (F.max("frame_idx") + 1).alias("end_frame"))
    )
    # Runs that a border of stretches cuts: only the first and last run of a stretch can go on beyond it.
    border = (F.col("first_frame") % STRETCH == 0) | (F.col("end_frame") % STRETCH == 0)
    cut = parts.withColumn("inside", F.when(~border, F.col("first_frame")))
    along = Window.partitionBy("chapter_num", "inside").orderBy("first_frame")
    starts = F.coalesce(F.lag("end_frame").over(along) != F.col("first_frame"), F.lit(True))
    runs = cut.withColumn("starts", starts).withColumn("run", F.sum(F.col("starts").cast("int")).over(along))
    return runs.groupBy("chapter_num", "inside", "run").agg(F.min("first_frame").alias("first_frame"), F.max("end_frame").alias("end_frame")).drop("inside", "run")


def silences(islands: DataFrame, hop_s: float, least: float = MIN_SILENCE) -> DataFrame:
    start, end = F.col("first_frame") * F.lit(hop_s), F.col("end_frame") * F.lit(hop_s)
    return islands.select("chapter_num", start.alias("start"), end.alias("end")).filter(F.col("end") - F.col("start") >= least)


def frame_at(t: Column, hop_s: float, n: Column) -> Column:
    """The frame of a time; halves go to the even frame."""
    return F.least(F.greatest(F.bround(t / hop_s).cast("int"), F.lit(0)), n - 1)


def probed(points: DataFrame, islands: DataFrame, stats: DataFrame, hop_s: float, probe: float = PROBE) -> DataFrame:
    """``points(chapter_num, point_id, t)`` with quiet_before, quiet_after and safety, in seconds."""
    most = round(probe / hop_s)
    at = points.join(stats.select("chapter_num", "n_frames"), "chapter_num").withColumn("f", frame_at(F.col("t"), hop_s, F.col("n_frames")))
    f = F.col("f")
    near = meeting(at, islands, (f, f), (F.col("first_frame"), F.col("end_frame")), 4 * most).filter((F.col("first_frame") <= f) & (F.col("end_frame") >= f))
    runs = near.groupBy("chapter_num", "point_id").agg(
        F.max(F.when(F.col("first_frame") < F.col("f"), F.least(F.lit(most), F.col("f") - F.col("first_frame")))).alias("b"),
        F.max(F.when(F.col("end_frame") > F.col("f"), F.least(F.lit(most), F.col("end_frame") - F.col("f")))).alias("a"),
    )
    before, after = F.coalesce("b", F.lit(0)) * hop_s, F.coalesce("a", F.lit(0)) * hop_s
    return points.join(runs, ["chapter_num", "point_id"], "left").withColumns(
        {"quiet_before": before, "quiet_after": after, "safety": F.when(F.coalesce("a", F.lit(0)) > 0, F.least(before, after)).otherwise(0.0)}
    ).drop("a", "b")


def reached(points: DataFrame, islands: DataFrame, stats: DataFrame, hop_s: float, limit: float, forward: bool) -> DataFrame:
    """How far a place can move to take in the silence beside it; 0 if none begins within the limit."""
    most = round(limit / hop_s)
    at = points.join(stats.select("chapter_num", "n_frames"), "chapter_num").withColumn("f", frame_at(F.col("t"), hop_s, F.col("n_frames")))
    look, edge = (next_after, "end_frame") if forward else (last_before, "first_frame")
    own = look(at, "f", islands, edge, F.struct("first_frame", "end_frame"), "i")
    if forward:
        steps = F.when(F.col("i.first_frame") - F.col("f") < most, F.least(F.lit(most), F.col("i.end_frame") - F.col("f")))
    else:
        steps = F.when(F.col("f") - F.col("i.end_frame") < most, F.least(F.lit(most), F.col("f") - F.col("i.first_frame")))
    reach = own.select("chapter_num", "point_id", (F.coalesce(steps, F.lit(0)) * hop_s).alias("reach"))
    return points.join(reach, ["chapter_num", "point_id"], "left").withColumn("reach", F.coalesce("reach", F.lit(0.0)))


def snapped(gaps: DataFrame, silence_rows: DataFrame, durations: DataFrame, search: float = SEARCH, least: float = MIN_SILENCE, bias: float = 0.5) -> DataFrame:
    """``gaps(chapter_num, point_id, t_end, t_start)`` with the cut in the best silence near each.

    Adds cut, confidence, method, silence_start, silence_end. Of equally good silences the first wins.
    """
    mid = (F.col("t_end") + F.col("t_start")) / 2
    own = gaps.join(durations.select("chapter_num", "duration"), "chapter_num").withColumn("mid", mid)
    own = own.withColumn("lo", F.greatest(F.lit(0.0), F.least(F.col("t_end"), F.col("mid")) - search)).withColumn(
        "hi", F.least(F.col("duration"), F.greatest(F.col("t_start"), F.col("mid")) + search)
    )
    quiet = silence_rows.withColumnRenamed("start", "s").withColumnRenamed("end", "e")
    near = meeting(own, quiet, (F.col("lo"), F.col("hi")), (F.col("s"), F.col("e")), 4 * search).filter((F.col("e") > F.col("lo")) & (F.col("s") < F.col("hi")))
    cut = (
        near.withColumn("s0", F.greatest("s", "lo")).withColumn("s1", F.least("e", "hi")).withColumn("span", F.col("s1") - F.col("s0"))
        .filter(F.col("span") >= least).withColumn("at", F.col("s0") + F.lit(bias) * F.col("span"))
        .withColumn("score", F.least("span", F.lit(0.5)) / 0.5 - F.lit(0.8) * F.abs(F.col("at") - F.col("mid")) / max(search, 1e-6))
        .groupBy("chapter_num", "point_id").agg(F.max_by(F.struct("at", "score", "s0", "s1"), F.struct("score", -F.col("s"))).alias("b"))
    )
    r3 = round3
    return gaps.join(cut, ["chapter_num", "point_id"], "left").select(
        *gaps.columns,
        r3(F.coalesce(F.col("b.at"), mid)).alias("cut"),
        r3(F.coalesce(F.least(F.greatest(F.col("b.score"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).alias("confidence"),
        F.when(F.col("b").isNull(), "midpoint").otherwise("silence").alias("method"),
        r3(F.coalesce(F.col("b.s0"), F.lit(0.0))).alias("silence_start"),
        r3(F.coalesce(F.col("b.s1"), F.lit(0.0))).alias("silence_end"),
    )


def edge_cuts(heads: DataFrame, tails: DataFrame, islands: DataFrame, stats: DataFrame, hop_s: float) -> DataFrame:
    """``edge``: where the first word's ``t`` (heads) and the last word's (tails) move to take in the silence beside them.

    ``stats``: chapter_num, n_frames, duration; an edge stays within the recording.
    """
    head = reached(heads, islands, stats, hop_s, HEAD_PAD, False).withColumn("edge", F.round(F.greatest(F.lit(0.0), F.col("t") - F.col("reach")), 3))
    tail = reached(tails, islands, stats, hop_s, TAIL_PAD, True).join(stats.select("chapter_num", "duration"), "chapter_num")
    tail = tail.withColumn("edge", F.round(F.least("duration", F.col("t") + F.col("reach")), 3))
    return head.select("chapter_num", "point_id", "edge").unionByName(tail.select("chapter_num", "point_id", "edge"))


def peaks(signals: DataFrame, bucket: int) -> DataFrame:
    """Least and greatest sample of whole buckets, as signed bytes."""
    n = F.floor(F.size("samples") / bucket).cast("int")
    part = lambda k: F.slice("samples", k * bucket + 1, F.lit(bucket))
    byte = lambda x: F.least(F.greatest(x.cast("double") * 127, F.lit(-127.0)), F.lit(127.0)).cast("int").cast("tinyint")
    rows = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)), lambda k: F.struct(byte(F.array_min(part(k))).alias("lo"), byte(F.array_max(part(k))).alias("hi")))
    return signals.select("chapter_num", F.posexplode(rows).alias("bucket", "p")).select("chapter_num", "bucket", "p.lo", "p.hi")
