"""Views and exports: conversations as chapters of boards of 2.5 s, labels as reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import views as V
from tidemark.plans.text_queries import TRIM_SQL, WORDS_SQL, _five, _kept, _spoken
from tidemark.sources.tables import table

BOARDS_SQL = """
SELECT 'book' || (conv_id % 7) AS book_id, conv_id AS chapter_num, turn + 1 AS chunk_id, coalesce(text, '') AS text, CASE role WHEN 'system' THEN 'intro_outro' WHEN 'user' THEN 'dialogue' ELSE 'narration' END AS chunk_type,
       turn * 2.5::DOUBLE AS start_time, turn * 2.5::DOUBLE + 2.4::DOUBLE AS end_time, 'b' || (turn * 10) AS cut_key FROM conversations
"""
REVIEWS_SQL = """
SELECT doc_id AS review_id, doc_id % 50 AS chapter_num, doc_id % 6 + 1 AS chunk_id, CASE WHEN doc_id % 3 > 0 THEN 'b' || (doc_id % 6 * 10) END AS cut_key, quality = 1 AS is_correct,
       CASE WHEN quality = 1 THEN 'ok' WHEN toxic = 1 THEN 'mismatch' ELSE 'timing_issue' END AS status, doc_id % 97 AS seen_at FROM labels
"""


def boards(spark, sf_dir):
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("book"), (F.col("conv_id") % 7).cast("string")).alias("book_id"), F.col("conv_id").alias("chapter_num"), (turn + 1).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("role") == "system", "intro_outro").when(F.col("role") == "user", "dialogue").otherwise("narration").alias("chunk_type"),
        (turn * F.lit(2.5)).alias("start_time"), (turn * F.lit(2.5) + 2.4).alias("end_time"), F.concat(F.lit("b"), (turn * 10).cast("string")).alias("cut_key"),
    )


def reviews(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        i.alias("review_id"), (i % 50).alias("chapter_num"), (i % 6 + 1).alias("chunk_id"), F.when(i % 3 > 0, F.concat(F.lit("b"), (i % 6 * 10).cast("string"))).alias("cut_key"),
        (F.col("quality") == 1).alias("is_correct"), F.when(F.col("quality") == 1, "ok").when(F.col("toxic") == 1, "mismatch").otherwise("timing_issue").alias("status"), (i % 97).alias("seen_at"),
    )


QUERIES = {
    "x1_srt": lambda s, d: V.srt(boards(s, d)),
    "x2_slashed": lambda s, d: V.slashed(boards(s, d)),
    "x3_labels": lambda s, d: V.labels(boards(s, d)),
    "x4_slices": lambda s, d: V.slices(boards(s, d)),
    "v4_overview": lambda s, d: V.overview(boards(s, d), reviews(s, d)),
    "v8_sample": lambda s, d: V.sample(boards(s, d)),
    "v8_unreviewed": lambda s, d: V.unreviewed(boards(s, d), reviews(s, d)),
    "v9_latest_reviews": lambda s, d: V.latest_reviews(reviews(s, d)),
    "v10_stats": lambda s, d: V.review_stats(reviews(s, d)),
    "v10_status_counts": lambda s, d: V.status_counts(reviews(s, d)),
    "v10_last_reviews": lambda s, d: V.last_reviews(reviews(s, d)),
    "w1_text_search": lambda s, d: boards(s, d).filter(F.contains(F.lower("text"), F.lit("the"))).select("chapter_num", "chunk_id"),
    "w2_board_at_time": lambda s, d: V.at_times(boards(s, d), boards(s, d).select("chapter_num", F.col("chunk_id").alias("time_id"), (F.col("start_time") * 1.3 + 1).alias("t"))),
}
_B = f"({BOARDS_SQL})"
_R = f"({REVIEWS_SQL})"
_MS = "CAST(round({0} * 1000) AS BIGINT)"
_STAMP = lambda c: f"format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', {_MS.format(c)} // 3600000, {_MS.format(c)} // 60000 % 60, {_MS.format(c)} // 1000 % 60, {_MS.format(c)} % 1000)"
_CUE = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {TRIM_SQL.format('l')}), lambda l: l <> ''), chr(10))"
_LATEST = f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY chapter_num, coalesce(cut_key, '#' || chunk_id) ORDER BY seen_at DESC, review_id DESC) AS n FROM {_R}) WHERE n = 1"
ORACLE_SQL = {
    "x1_srt": f"SELECT book_id, chapter_num, string_agg(chunk_id || chr(10) || {_STAMP('start_time')} || ' --> ' || {_STAMP('end_time')} || chr(10) || {_CUE} || chr(10), chr(10) ORDER BY chunk_id) AS srt FROM {_B} GROUP BY ALL",
    "x2_slashed": f"SELECT book_id, chapter_num, string_agg(t, chr(10) || '///' || chr(10) ORDER BY chunk_id) AS slashed FROM (SELECT *, {TRIM_SQL.format('text')} AS t FROM {_B}) WHERE t <> '' GROUP BY ALL",
    "x3_labels": f"""SELECT book_id, chapter_num, string_agg(format('{{:.6f}}', start_time) || chr(9) || format('{{:.6f}}', end_time) || chr(9) ||
        CASE WHEN len({WORDS_SQL.format(_spoken)}) > 0 THEN upper(replace(array_to_string({_five}, ' '), 'ß', 'ss')) WHEN chunk_type = 'intro_outro' THEN 'BRAK TEKSTU W ŹRÓDLE' ELSE 'PLANSZA ' || chunk_id END, chr(10) ORDER BY chunk_id) AS labels FROM {_B} GROUP BY ALL""",
    "x4_slices": f"""SELECT book_id, chapter_num, chunk_id, start_time, round(greatest(0.1, end_time - start_time), 3) AS length,
        lpad(CAST(chunk_id AS VARCHAR), 3, '0') || ' - ' || CASE WHEN len({_five}) = 0 THEN 'fragment' WHEN {_kept} = '' THEN 'audio_fragment' ELSE {_kept} END || '.mp3' AS file FROM {_B}""",
    "v4_overview": f"SELECT b.chapter_num, book_id, count(*) AS boards, round(max(end_time), 3) AS duration, coalesce(any_value(r.n), 0) AS reviewed FROM {_B} b LEFT JOIN (SELECT chapter_num, count(*) AS n FROM ({_LATEST}) GROUP BY 1) r ON r.chapter_num = b.chapter_num GROUP BY 1, 2",
    "v8_sample": f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY sha1('1:' || chapter_num || ':' || chunk_id)) AS n FROM (SELECT *, coalesce(lag(chunk_id) OVER w, -1) AS previous, coalesce(lead(chunk_id) OVER w, -1) AS next FROM {_B} WINDOW w AS (PARTITION BY book_id, chapter_num ORDER BY chunk_id))) WHERE n = 1",
    "v8_unreviewed": f"SELECT b.* FROM {_B} b WHERE NOT EXISTS (SELECT 1 FROM {_R} r WHERE r.chapter_num = b.chapter_num AND (r.cut_key = b.cut_key OR r.chunk_id = b.chunk_id))",
    "v9_latest_reviews": _LATEST,
    "v10_stats": f"SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct) AS incorrect, coalesce(round(count(*) FILTER (is_correct) * 100.0::DOUBLE / nullif(count(*), 0), 1), 100.0) AS accuracy FROM {_R}",
    "v10_status_counts": f"SELECT status, count(*) AS n FROM {_R} GROUP BY status",
    "v10_last_reviews": f"SELECT * FROM {_R} ORDER BY seen_at DESC, review_id DESC LIMIT 10",
    "w1_text_search": f"SELECT chapter_num, chunk_id FROM {_B} WHERE contains(lower(text), 'the')",
    "w2_board_at_time": f"""SELECT q.chapter_num, q.time_id, q.t, coalesce(min(CASE WHEN start_time <= t AND t < end_time THEN chunk_id END), arg_min(chunk_id, CASE WHEN start_time > t THEN start_time END), max(chunk_id)) AS chunk_id
        FROM (SELECT chapter_num, chunk_id AS time_id, start_time * 1.3::DOUBLE + 1 AS t FROM {_B}) q JOIN {_B} b ON b.chapter_num = q.chapter_num GROUP BY 1, 2, 3""",
}
