"""Signal queries: each embedding is a signal of 64 samples, in frames of 8 that last a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import signal as G
from tidemark.sources.tables import frames as signals

HOP, HOP_S = 8, 1.0
QUERIES, ORACLE_SQL = {}, {}

FRAMES_SQL = """
SELECT vec_id AS chapter_num, CAST(k AS INTEGER) AS frame_idx,
       CAST(sqrt(list_sum(list_transform(embedding[k * 8 + 1 : k * 8 + 8], lambda x: x::DOUBLE * x::DOUBLE)) / 8) AS FLOAT) AS rms
FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 8)) AS k FROM embeddings)
"""
# The quantiles of a signal are so close that a tenth above the floor makes a better threshold here.
LEVEL = 1.25
STATS_SQL = f"""
SELECT chapter_num, CAST(count(*) AS INTEGER) AS n_frames, quantile_cont(rms::DOUBLE, 0.05) AS noise_floor, quantile_cont(rms::DOUBLE, 0.75) AS speech_level,
       least(greatest(greatest(quantile_cont(rms::DOUBLE, 0.05) * 3, quantile_cont(rms::DOUBLE, 0.75) * 0.06), 1e-4), greatest(quantile_cont(rms::DOUBLE, 0.75) * 0.35, 1e-4)) AS threshold
FROM ({FRAMES_SQL}) GROUP BY chapter_num
"""
ISLANDS_SQL = f"""
SELECT chapter_num, CAST(min(frame_idx) AS INTEGER) AS first_frame, CAST(max(frame_idx) + 1 AS INTEGER) AS end_frame
FROM (SELECT f.chapter_num, frame_idx, frame_idx - row_number() OVER (PARTITION BY f.chapter_num ORDER BY frame_idx) AS run
      FROM ({FRAMES_SQL}) f JOIN ({STATS_SQL}) s ON f.chapter_num = s.chapter_num WHERE rms < s.noise_floor * {LEVEL})
GROUP BY chapter_num, run
"""
POINTS_SQL = "SELECT vec_id AS chapter_num, p AS point_id, p * 1.7 AS t FROM embeddings, (SELECT unnest([0, 1, 2, 3, 4]) AS p)"


def _all(spark, sf_dir):
    rows = G.frames(signals(spark, sf_dir), HOP)
    stats = G.envelope_stats(rows)
    return rows, stats, G.quiet_islands(rows, stats.withColumn("threshold", F.col("noise_floor") * LEVEL))


def _points(spark, sf_dir):
    return signals(spark, sf_dir).select("chapter_num", F.explode(F.array(*map(F.lit, range(5)))).alias("point_id")).withColumn("t", F.col("point_id") * F.lit(1.7))


def e1_envelope(spark, sf_dir):
    return G.frames(signals(spark, sf_dir), HOP)


def e2_threshold(spark, sf_dir):
    return G.envelope_stats(G.frames(signals(spark, sf_dir), HOP))


def e3_silences(spark, sf_dir):
    return G.silences(_all(spark, sf_dir)[2], HOP_S, 2.0)


def e6_cut_safety(spark, sf_dir):
    _, stats, islands = _all(spark, sf_dir)
    return G.probed(_points(spark, sf_dir), islands, stats, HOP_S, 3.0)


def e8_edge_reach(spark, sf_dir):
    _, stats, islands = _all(spark, sf_dir)
    ahead = G.reached(_points(spark, sf_dir), islands, stats, HOP_S, 3.0, True).withColumnRenamed("reach", "forward")
    return ahead.join(G.reached(_points(spark, sf_dir), islands, stats, HOP_S, 3.0, False).drop("t").withColumnRenamed("reach", "backward"), ["chapter_num", "point_id"])


def e7_snapped_cuts(spark, sf_dir):
    _, stats, islands = _all(spark, sf_dir)
    gaps = _points(spark, sf_dir).select("chapter_num", "point_id", F.col("t").alias("t_end"), (F.col("t") + 0.5).alias("t_start"))
    return G.snapped(gaps, G.silences(islands, HOP_S, 1.0), stats.withColumn("duration", F.col("n_frames") * F.lit(HOP_S)), 2.0, 0.5)


def e10_peaks(spark, sf_dir):
    return G.peaks(signals(spark, sf_dir), 16)


def e14_safety_report(spark, sf_dir):
    """How many cuts are safe, and their median margin, before and after snapping."""
    _, stats, islands = _all(spark, sf_dir)
    snap = e7_snapped_cuts(spark, sf_dir)
    before = G.probed(snap.select("chapter_num", "point_id", F.col("t_end").alias("t")), islands, stats, HOP_S, 3.0).withColumn("side", F.lit("before"))
    after = G.probed(snap.select("chapter_num", "point_id", F.col("cut").alias("t")), islands, stats, HOP_S, 3.0).withColumn("side", F.lit("after"))
    return before.unionByName(after).groupBy("side").agg(
        F.count(F.lit(1)).alias("cuts"), F.count_if(F.col("safety") >= G.SAFE).alias("safe"), F.median("safety").alias("median_safety")
    )


QUERIES = {f.__name__: f for f in (e1_envelope, e2_threshold, e3_silences, e6_cut_safety, e7_snapped_cuts, e8_edge_reach, e10_peaks, e14_safety_report)}
ORACLE_SQL["e1_envelope"] = FRAMES_SQL
ORACLE_SQL["e2_threshold"] = STATS_SQL
ORACLE_SQL["e3_silences"] = f'SELECT chapter_num, first_frame * 1.0::DOUBLE AS start, end_frame * 1.0::DOUBLE AS "end" FROM ({ISLANDS_SQL}) WHERE end_frame - first_frame >= 2'
_F = f"SELECT p.*, CAST(least(greatest(round_even(t, 0), 0), 7) AS INTEGER) AS f FROM ({POINTS_SQL}) p"
_PROBED = f"""
SELECT chapter_num, point_id, CAST(t AS DOUBLE) AS t, coalesce(b, 0)::DOUBLE AS quiet_before, coalesce(a, 0)::DOUBLE AS quiet_after,
       CASE WHEN coalesce(a, 0) > 0 THEN least(coalesce(b, 0), coalesce(a, 0)) ELSE 0 END::DOUBLE AS safety
FROM (SELECT f.chapter_num, point_id, t, max(CASE WHEN first_frame < f THEN least(3, f - first_frame) END) AS b, max(CASE WHEN end_frame > f THEN least(3, end_frame - f) END) AS a
      FROM ({{points}}) f LEFT JOIN ({ISLANDS_SQL}) i ON i.chapter_num = f.chapter_num AND first_frame <= f AND end_frame >= f GROUP BY f.chapter_num, point_id, t)
"""
ORACLE_SQL["e6_cut_safety"] = _PROBED.format(points=_F)
ORACLE_SQL["e8_edge_reach"] = f"""
SELECT chapter_num, point_id, CAST(t AS DOUBLE) AS t,
       coalesce(CASE WHEN n[1] - f < 3 THEN least(3, n[2] - f) END, 0)::DOUBLE AS forward, coalesce(CASE WHEN f - l[2] < 3 THEN least(3, f - l[1]) END, 0)::DOUBLE AS backward
FROM (SELECT f.chapter_num, point_id, t, f, min(CASE WHEN end_frame > f THEN [first_frame, end_frame] END) AS n, max(CASE WHEN first_frame < f THEN [first_frame, end_frame] END) AS l
      FROM ({_F}) f LEFT JOIN ({ISLANDS_SQL}) i ON i.chapter_num = f.chapter_num GROUP BY f.chapter_num, point_id, t, f)
"""
_SNAP = f"""
WITH g AS (SELECT chapter_num, point_id, CAST(t AS DOUBLE) AS t_end, t::DOUBLE + 0.5 AS t_start, (t::DOUBLE + t::DOUBLE + 0.5) / 2 AS mid FROM ({POINTS_SQL})),
w AS (SELECT *, greatest(0.0, least(t_end, mid) - 2) AS lo, least(8.0, greatest(t_start, mid) + 2) AS hi FROM g),
s AS (SELECT w.*, i.first_frame, greatest(first_frame, lo) AS s0, least(end_frame, hi) AS s1 FROM w JOIN ({ISLANDS_SQL}) i ON i.chapter_num = w.chapter_num AND end_frame > lo AND first_frame < hi),
c AS (SELECT *, s0 + 0.5 * (s1 - s0) AS at, least(s1 - s0, 0.5) / 0.5 - 0.8 * abs(s0 + 0.5 * (s1 - s0) - mid) / 2 AS score FROM s WHERE s1 - s0 >= 0.5),
b AS (SELECT *, row_number() OVER (PARTITION BY chapter_num, point_id ORDER BY score DESC, first_frame) AS n FROM c)
SELECT g.chapter_num, g.point_id, g.t_end, g.t_start, floor((coalesce(b.at, g.mid)) * 1000 + 0.500001) / 1000.0::DOUBLE AS cut, floor((coalesce(least(greatest(score, 0.0), 1.0), 0.0)) * 1000 + 0.500001) / 1000.0::DOUBLE AS confidence,
       CASE WHEN b.at IS NULL THEN 'midpoint' ELSE 'silence' END AS method, floor((coalesce(s0, 0.0)) * 1000 + 0.500001) / 1000.0::DOUBLE AS silence_start, floor((coalesce(s1, 0.0)) * 1000 + 0.500001) / 1000.0::DOUBLE AS silence_end
FROM g LEFT JOIN b ON b.chapter_num = g.chapter_num AND b.point_id = g.point_id AND n = 1
"""
ORACLE_SQL["e7_snapped_cuts"] = _SNAP
ORACLE_SQL["e10_peaks"] = """
SELECT vec_id AS chapter_num, CAST(k AS INTEGER) AS bucket, CAST(trunc(least(greatest(list_min(p)::DOUBLE * 127, -127), 127)) AS TINYINT) AS lo, CAST(trunc(least(greatest(list_max(p)::DOUBLE * 127, -127), 127)) AS TINYINT) AS hi
FROM (SELECT vec_id, k, embedding[k * 16 + 1 : k * 16 + 16] AS p FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 16)) AS k FROM embeddings))
"""
_AT = lambda c: f"SELECT chapter_num, point_id, {c} AS t, CAST(least(greatest(round_even({c}, 0), 0), 7) AS INTEGER) AS f FROM ({_SNAP})"
ORACLE_SQL["e14_safety_report"] = f"""
SELECT side, count(*) AS cuts, count(*) FILTER (safety >= 0.08) AS safe, median(safety) AS median_safety
FROM (SELECT 'before' AS side, safety FROM ({_PROBED.format(points=_AT("t_end"))}) UNION ALL SELECT 'after', safety FROM ({_PROBED.format(points=_AT("cut"))})) GROUP BY side
"""
