"""Queries of names and bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import timing as T
from tidemark.plans.timing_queries import WORDS_SQL
from tidemark.sources import files as S
from tidemark.sources import recordings as R
from tidemark.sources.tables import table

ENDS = ("mp3", "TXT", "Flac", "doc")


def _names(spark, sf_dir):
    i = F.col("doc_id")
    number = F.lpad((i % 1000).cast("string"), 3, "0")
    stem = F.when(i % 3 == 0, F.concat("source", F.lit(" Rozdzial-"), number)).when(i % 3 == 1, F.concat("source", F.lit("_"), number, F.lit("_x"))).otherwise(F.concat("source", number))
    name = F.concat(stem, F.lit("."), F.element_at(F.array(*map(F.lit, ENDS)), (i % 4 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))


def s11_chapter_of_name(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("chapter", S.chapter_of(F.col("name")))


def s15_audio_files(spark, sf_dir):
    return _names(spark, sf_dir).filter(S.is_audio(F.col("name")))


def w3_confidence_bands(spark, sf_dir):
    share = F.col("l_extendedprice") / F.lit(1e5) - F.floor(F.col("l_extendedprice") / F.lit(1e5))
    return table(spark, sf_dir, "lineitem").select(S.confidence_band(share).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def u7_ordered_cuts(spark, sf_dir):
    """Cut times forced into order: words' ends, pulled back by up to six hours where the index is odd."""
    words = R.word_times(spark, sf_dir)
    t = F.greatest(F.lit(0.0), F.col("end") - F.when(F.col("token_idx") % 2 == 1, F.col("token_idx") % 7).otherwise(0))
    rows = words.select("chapter_num", F.col("token_idx").alias("point_id"), t.alias("t"))
    # The recording ends with the latest cut, so the last ones meet its end.
    rows = rows.join(rows.groupBy("chapter_num").agg(F.max("t").alias("duration")), "chapter_num")
    return T.in_order(rows).select("chapter_num", F.col("point_id").alias("idx"), F.round("time", 6).alias("time"))


QUERIES = {f.__name__: f for f in (s11_chapter_of_name, s15_audio_files, w3_confidence_bands, u7_ordered_cuts)}
_NAMES = "SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN ' Rozdzial-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN '_' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '_x' ELSE lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') END || '.' || ['mp3', 'TXT', 'Flac', 'doc'][doc_id % 4 + 1] AS name FROM documents"
ORACLE_SQL = {
    "s11_chapter_of_name": f"SELECT *, CASE WHEN doc_id % 3 < 2 THEN CAST(doc_id % 1000 AS INTEGER) END AS chapter FROM ({_NAMES})",
    "s15_audio_files": f"SELECT * FROM ({_NAMES}) WHERE doc_id % 4 IN (0, 2)",
    "w3_confidence_bands": "SELECT CASE WHEN s >= 0.75 THEN 'high' WHEN s >= 0.45 THEN 'middle' ELSE 'low' END AS band, count(*) AS n FROM (SELECT l_extendedprice / 1e5 - floor(l_extendedprice / 1e5) AS s FROM lineitem) GROUP BY 1",
    "u7_ordered_cuts": f"""
WITH w AS (SELECT chapter_num, token_idx AS idx, greatest(0.0, "end" - CASE WHEN token_idx % 2 = 1 THEN token_idx % 7 ELSE 0 END) AS t FROM ({WORDS_SQL})),
p AS (SELECT *, max(t - idx * 0.2::DOUBLE) OVER (PARTITION BY chapter_num ORDER BY idx) + idx * 0.2::DOUBLE AS pushed, max(t) OVER (PARTITION BY chapter_num) AS latest FROM w)
SELECT chapter_num, idx, round(CASE WHEN pushed > t + 1e-9 THEN greatest(t, round(least(pushed, latest), 3)) ELSE t END, 6) AS time FROM p
""",
}
