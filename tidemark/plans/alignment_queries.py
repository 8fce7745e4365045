"""Alignment queries: conversations as texts and their garbled copies as transcripts; events as word times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import alignment as A
from tidemark.operators import segments as S
from tidemark.plans.timing_queries import SEGMENTS_SQL, WORDS_SQL, steps
from tidemark.sources import recordings as R
from tidemark.sources.tables import dialogue_chapters

QUERIES, ORACLE_SQL = {}, {}


def _texts(spark, sf_dir):
    """A chapter's tokens, and what a listener made of them: every ninth word is left out, every seventh garbled."""
    book = S.tokens(dialogue_chapters(spark, sf_dir)).select("chapter_num", "token_idx", "word", X.normal_word(F.col("word")).alias("norm"))
    heard = book.filter("token_idx % 9 <> 5").withColumn("norm", F.when(F.col("token_idx") % 7 == 3, F.concat("norm", F.lit("x"))).otherwise(F.col("norm")))
    return book, heard.withColumnRenamed("token_idx", "heard_idx")


def a1_matches(spark, sf_dir):
    return A.matches(*_texts(spark, sf_dir), fuzzy=2.0)


def a2_fuzzy_matches(spark, sf_dir):
    return A.matches(*_texts(spark, sf_dir))


def _gappy(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    hit = F.col("matched") & (F.col("chapter_num") % 11 != 0)
    return words, words.select("chapter_num", "token_idx", F.when(hit, F.col("start")).alias("start"), F.when(hit, F.col("end")).alias("end"))


def a5_word_times(spark, sf_dir):
    words, gappy = _gappy(spark, sf_dir)
    return A.interpolated(gappy, R.stats(words))


def a6_board_times(spark, sf_dir):
    boards = R.book_boards(R.word_times(spark, sf_dir))
    return A.board_times(boards.select("chapter_num", (F.col("lo") / R.BOARD).cast("int").alias("board_idx"), (F.col("first_start") - 3).alias("s"), F.col("last_end").alias("e")))


def a8_extras(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    heard = words.select("chapter_num", F.col("token_idx").alias("heard_idx"), "word", "start", "end", F.when(F.col("token_idx") % 20 < 12, F.col("token_idx")).alias("token_idx"))
    return A.extras(heard, R.stats(words).select("chapter_num", "token_count"))


def a9_report(spark, sf_dir):
    return A.report(R.word_times(spark, sf_dir))


def s10_even_words(spark, sf_dir):
    return A.spread(R.segments(R.word_times(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (a1_matches, a2_fuzzy_matches, a5_word_times, a6_board_times, a8_extras, a9_report, s10_even_words)}
ORACLE_SQL["a6_board_times"] = steps(
    """SELECT chapter_num, board_idx, round(st, 3) AS start_time, round(en, 3) AS end_time FROM r""", "bb"
).replace("WITH ", "WITH RECURSIVE ", 1).replace(
    " SELECT chapter_num, board_idx, round(st",
    """, r AS (SELECT chapter_num, board AS board_idx, greatest(first_start - 3, 0.0) AS st, greatest(greatest(first_start - 3, 0.0) + 0.5, last_end) AS en FROM bb WHERE board = 0
    UNION ALL SELECT bb.chapter_num, board, greatest(first_start - 3, en), greatest(greatest(first_start - 3, en) + 0.5, last_end) FROM r JOIN bb ON bb.chapter_num = r.chapter_num AND board = board_idx + 1)
    SELECT chapter_num, board_idx, round(st""", 1,
)
ORACLE_SQL["a9_report"] = f"SELECT chapter_num, count(*) AS words, count(*) FILTER (matched) AS matched, round(count(*) FILTER (matched) * 100.0::DOUBLE / count(*), 2) AS match_percentage FROM ({WORDS_SQL}) GROUP BY chapter_num"
ORACLE_SQL["a5_word_times"] = f"""
WITH w0 AS ({WORDS_SQL}),
w1 AS (SELECT chapter_num, token_idx, CASE WHEN matched AND chapter_num % 11 <> 0 THEN start END AS s, CASE WHEN matched AND chapter_num % 11 <> 0 THEN "end" END AS e, (floor((max("end") OVER (PARTITION BY chapter_num) + 1) * 1000 + 0.500001) / 1000.0::DOUBLE) AS d FROM w0),
w AS (SELECT *, last_value(CASE WHEN s IS NOT NULL THEN token_idx END IGNORE NULLS) OVER b AS p, last_value(e IGNORE NULLS) OVER b AS pe,
             first_value(CASE WHEN s IS NOT NULL THEN token_idx END IGNORE NULLS) OVER a AS q, first_value(s IGNORE NULLS) OVER a AS qs, count(*) OVER (PARTITION BY chapter_num) AS n
      FROM w1 WINDOW b AS (PARTITION BY chapter_num ORDER BY token_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY chapter_num ORDER BY token_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x AS (SELECT *, greatest((q - p - 1) * 0.05::DOUBLE, qs - pe) / (q - p - 1 + 1) AS step, greatest(0.0, qs - (q - token_idx) * 0.35::DOUBLE) AS l, token_idx - p - 1 AS k FROM w)
SELECT chapter_num, token_idx,
       CASE WHEN s IS NOT NULL THEN s WHEN p IS NULL AND q IS NULL THEN (floor((token_idx * (d / n)) * 1000 + 0.500001) / 1000.0::DOUBLE) WHEN p IS NULL THEN (floor((l) * 1000 + 0.500001) / 1000.0::DOUBLE) WHEN q IS NULL THEN (floor((least(d, pe + k * 0.35::DOUBLE)) * 1000 + 0.500001) / 1000.0::DOUBLE) ELSE (floor((pe + k * step) * 1000 + 0.500001) / 1000.0::DOUBLE) END AS start,
       CASE WHEN s IS NOT NULL THEN e WHEN p IS NULL AND q IS NULL THEN (floor(((token_idx + 1) * (d / n)) * 1000 + 0.500001) / 1000.0::DOUBLE) WHEN p IS NULL THEN (floor((greatest(l + 0.1::DOUBLE, qs - (q - token_idx - 1) * 0.35::DOUBLE)) * 1000 + 0.500001) / 1000.0::DOUBLE)
            WHEN q IS NULL THEN (floor((least(d, pe + (k + 1) * 0.35::DOUBLE)) * 1000 + 0.500001) / 1000.0::DOUBLE) ELSE (floor((pe + (k + 1) * step) * 1000 + 0.500001) / 1000.0::DOUBLE) END AS "end", s IS NOT NULL AS matched
FROM x
"""
ORACLE_SQL["a8_extras"] = f"""
WITH w AS (SELECT *, CASE WHEN token_idx % 20 < 12 THEN token_idx END AS hit FROM ({WORDS_SQL})),
r AS (SELECT *, count(hit) OVER (PARTITION BY chapter_num ORDER BY token_idx) AS run, first_value(hit IGNORE NULLS) OVER (PARTITION BY chapter_num ORDER BY token_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt, count(*) OVER (PARTITION BY chapter_num) AS n FROM w)
SELECT chapter_num, CAST(coalesce(any_value(nxt), any_value(n)) AS INTEGER) AS anchor, CASE WHEN min(token_idx) = 0 THEN 'intro' WHEN any_value(nxt) IS NULL THEN 'outro' ELSE 'inline' END AS position,
       min(start) AS start_time, max("end") AS end_time, CAST(count(*) AS INTEGER) AS word_count, string_agg(word, ' ' ORDER BY token_idx) AS heard
FROM r WHERE hit IS NULL GROUP BY chapter_num, run HAVING round(max("end") - min(start), 6) >= 1.5 AND count(*) >= 4
"""
ORACLE_SQL["s10_even_words"] = f"""
SELECT chapter_num, CAST(seg_id AS INTEGER) AS seg_id, CAST(k - 1 AS INTEGER) AS word_idx, ws[k] AS word, (floor((start + (k - 1) * (("end" - start) / len(ws))) * 1000 + 0.500001) / 1000.0::DOUBLE) AS start, (floor((start + k * (("end" - start) / len(ws))) * 1000 + 0.500001) / 1000.0::DOUBLE) AS "end", 1.0::DOUBLE AS probability
FROM (SELECT *, string_split(text, ' ') AS ws, unnest(range(1, len(string_split(text, ' ')) + 1)) AS k FROM ({SEGMENTS_SQL}))
"""
