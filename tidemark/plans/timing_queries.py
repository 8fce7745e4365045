"""Timing queries over events as recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import timing as T
from tidemark.plans.text_queries import wrap_sql
from tidemark.sources import recordings as R
from tidemark.sources.scratch import materialise

QUERIES, ORACLE_SQL = {}, {}
SEARCH, LEAST = 4.0, 0.1


def _base(spark, sf_dir):
    words = materialise(R.word_times(spark, sf_dir), "words")
    boards = materialise(R.book_boards(words), "boards")
    fixed = boards.filter("lo % 35 = 0").select("chapter_num", "lo", "hi", F.concat(F.lit("fixed "), "text").alias("fixed"))
    units = T.units(boards, T.insert_units(R.inserts(words)), fixed, R.stats(words).select("chapter_num", "token_count"))
    return words, materialise(units, "units")


def _cuts(spark, sf_dir):
    words, units = _base(spark, sf_dir)
    manual = R.book_boards(words).filter("lo % 42 = 7").select("chapter_num", F.concat(F.lit("b"), "lo").alias("key"), F.round(F.col("first_start") + 0.1, 3).alias("manual"))
    rows = T.cuts(units, R.islands(words), materialise(R.stats(words), "stats"), R.silence(words).filter(f"end - start >= {LEAST}"), R.segments(words), manual, R.HOP_S, SEARCH, LEAST)
    return units, materialise(rows, "cuts")


def u1_heard_text(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    spans = words.select("chapter_num", F.col("token_idx").alias("span_id"), (F.col("start") - 8).alias("start"), (F.col("end") + 8).alias("end"))
    return T.heard(spans, R.segments(words))


def u2_insert_units(spark, sf_dir):
    return T.insert_units(R.inserts(R.word_times(spark, sf_dir)))


def a12_insert_words(spark, sf_dir):
    return T.insert_words(T.insert_texts(R.inserts(R.word_times(spark, sf_dir))).filter("n > 0"))


def u3_units(spark, sf_dir):
    return _base(spark, sf_dir)[1]


def u4_cuts(spark, sf_dir):
    return _cuts(spark, sf_dir)[1]


def u8_timed_boards(spark, sf_dir):
    return T.timed_boards(*_cuts(spark, sf_dir))


def u9_summary(spark, sf_dir):
    units, cuts = _cuts(spark, sf_dir)
    return T.summary(T.timed_boards(units, cuts), cuts)


def u11_totals(spark, sf_dir):
    rows = u9_summary(spark, sf_dir)
    names = [c for c in rows.columns if c != "chapter_num"]
    return rows.groupBy((F.col("chapter_num") % 5).alias("book")).agg(*(F.sum(c).alias(c) for c in names))


def l13_bounds(spark, sf_dir):
    return T.bounds(R.layouts(R.word_times(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (u1_heard_text, u2_insert_units, a12_insert_words, u3_units, u4_cuts, u8_timed_boards, u9_summary, u11_totals, l13_bounds)}

MARKS_SQL = """
SELECT user_id AS chapter_num, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx, event_id, event_type, value,
       round(epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id), 3) AS t FROM events
"""
WORDS_SQL = f"""
SELECT chapter_num, idx AS token_idx, event_type || (event_id % 10) AS word, start,
       (floor((start + least(coalesce(lead(start) OVER (PARTITION BY chapter_num ORDER BY idx) - start, 1.0) / 2, 0.5)) * 1000 + 0.500001) / 1000.0::DOUBLE) AS "end", event_id % 3 <> 0 AS matched
FROM (SELECT *, (floor((t / 3600) * 1000 + 0.500001) / 1000.0::DOUBLE) AS start FROM ({MARKS_SQL}))
"""
SEGMENTS_SQL = f"""
SELECT chapter_num, token_idx // 5 AS seg_id, min(start) AS start, max("end") AS "end", string_agg(word, ' ' ORDER BY token_idx) AS text FROM ({WORDS_SQL}) GROUP BY chapter_num, token_idx // 5
"""


def r3(x: str) -> str:
    return f"(floor(({x}) * 1000 + 0.500001) / 1000.0::DOUBLE)"


def frame(t: str) -> str:
    return f"CAST(least(greatest(round_even({t} / 0.01::DOUBLE, 0), 0), n_frames - 1) AS INTEGER)"


#: The recordings and what is made of them, step by step.
STEPS = {
    "w": WORDS_SQL,
    "seg": SEGMENTS_SQL,
    "st": """SELECT chapter_num, round(max("end") + 1, 3) AS duration, CAST(floor(round(max("end") + 1, 3) / 0.01::DOUBLE) AS INTEGER) AS n_frames, CAST(count(*) AS INTEGER) AS token_count FROM w GROUP BY 1""",
    "sil": """SELECT * FROM (SELECT chapter_num, "end" AS s, lead(start) OVER (PARTITION BY chapter_num ORDER BY token_idx) AS e FROM w) WHERE e > s""",
    "isl": "SELECT * FROM (SELECT chapter_num, CAST(round(s / 0.01::DOUBLE) AS INTEGER) AS f0, CAST(round(e / 0.01::DOUBLE) AS INTEGER) AS f1 FROM sil) WHERE f1 > f0",
    "bb": """SELECT chapter_num, CAST(token_idx // 7 AS INTEGER) AS board, CAST(min(token_idx) AS INTEGER) AS lo, CAST(max(token_idx) + 1 AS INTEGER) AS hi, arg_min(start, token_idx) AS first_start, arg_max("end", token_idx) AS last_end,
             string_agg(word, ' ' ORDER BY token_idx) AS text, bool_and(matched) AS dialogue FROM w GROUP BY 1, 2""",
    "ins": "SELECT chapter_num, token_idx AS anchor, greatest(0.0::DOUBLE, start - 0.4::DOUBLE) AS st, start AS et, matched AS edited, word AS said, token_idx % 56 = 0 AS timed FROM w WHERE token_idx % 28 = 0",
    "iw": f"""SELECT *, CASE WHEN timed AND word = 'heard' THEN st WHEN timed AND word = said THEN {r3('(st + et) / 2')} END AS hs, CASE WHEN timed AND word = 'heard' THEN {r3('(st + et) / 2')} WHEN timed AND word = said THEN et END AS he
              FROM (SELECT *, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS k, len(ws) AS n FROM (SELECT *, CASE WHEN edited THEN ['typed', said, 'of', 'a', 'user'] ELSE ['heard', said] END AS ws FROM ins))""",
    "iq": """SELECT *, last_value(CASE WHEN hs IS NOT NULL THEN k END IGNORE NULLS) OVER b AS p, last_value(he IGNORE NULLS) OVER b AS pe, first_value(CASE WHEN hs IS NOT NULL THEN k END IGNORE NULLS) OVER a AS q, first_value(hs IGNORE NULLS) OVER a AS qs
             FROM iw WINDOW b AS (PARTITION BY chapter_num, anchor ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY chapter_num, anchor ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
    "it": f"""SELECT chapter_num, anchor, k, word, edited, n, coalesce(hs, {r3('t0 + kk * step')}) AS s, coalesce(he, CASE WHEN nothing THEN {r3('st + (k + 1) * step')} ELSE {r3('t0 + kk * step + step')} END) AS e
              FROM (SELECT *, CASE WHEN nothing THEN (et - st) / n ELSE greatest(0.02::DOUBLE, (coalesce(qs, et) - t0) / (coalesce(q, n) - coalesce(p, -1) - 1 + 1)) END AS step
                    FROM (SELECT *, p IS NULL AND q IS NULL AS nothing, coalesce(pe, st) AS t0, k - coalesce(p, -1) - 1 AS kk FROM iq))""",
    "iu": """SELECT chapter_num, anchor, board AS insert_board, 'i' || anchor || '.' || board AS cut_key, string_agg(word, ' ' ORDER BY k) || CASE WHEN board = any_value(last) THEN chr(10) || '(brak tekstu w pliku txt)' ELSE '' END AS text,
             any_value(edited) AS edited, arg_min(s, k) AS first_start, arg_max(e, k) AS last_end
             FROM (SELECT *, CAST(CASE WHEN n > 2 AND k >= 2 THEN 1 ELSE 0 END AS INTEGER) AS board, CASE WHEN n > 2 THEN 1 ELSE 0 END AS last FROM it) GROUP BY 1, 2, 3""",
    "un": """SELECT * EXCLUDE (place, is_book), CAST(row_number() OVER (PARTITION BY chapter_num ORDER BY place, is_book, insert_board) - 1 AS INTEGER) AS unit_idx FROM (
             SELECT chapter_num, lo AS place, 1 AS is_book, -1 AS insert_board, 'b' || lo AS cut_key, 'book' AS kind, CASE WHEN lo % 35 = 0 THEN 'fixed ' || text ELSE text END AS text, dialogue, lo AS token_start, hi AS token_end, -1 AS anchor, false AS edited,
                    lo % 35 = 0 AS corrected, first_start, last_end FROM bb
             UNION ALL SELECT chapter_num, anchor, 0, insert_board, cut_key, 'insert', text, false, -1, -1, anchor, edited, false, first_start, last_end FROM iu)""",
    "pt": """SELECT p.*, duration, n_frames, idx = 0 AS is_first, manual FROM (
               SELECT chapter_num, unit_idx AS idx, cut_key AS key, lag(last_end) OVER (PARTITION BY chapter_num ORDER BY unit_idx) AS we, first_start AS ws, false AS is_last FROM un
               UNION ALL SELECT chapter_num, CAST(max(unit_idx) + 1 AS INTEGER), 'end', arg_max(last_end, unit_idx), NULL, true FROM un GROUP BY 1) p
             JOIN st ON st.chapter_num = p.chapter_num
             LEFT JOIN (SELECT chapter_num, 'b' || lo AS own, round(first_start + 0.1::DOUBLE, 3) AS manual FROM bb WHERE lo % 42 = 7) m ON m.chapter_num = p.chapter_num AND m.own = p.key""",
    "edge": f"""SELECT chapter_num, idx, round(greatest(0.0::DOUBLE, ws - coalesce(CASE WHEN f - l[2] < 25 THEN least(25, f - l[1]) END, 0) * 0.01::DOUBLE), 3) AS edge
                FROM (SELECT h.chapter_num, idx, ws, f, max(CASE WHEN f0 < f THEN [f0, f1] END) AS l FROM (SELECT *, {frame('ws')} AS f FROM pt WHERE is_first AND manual IS NULL) h LEFT JOIN isl ON isl.chapter_num = h.chapter_num GROUP BY 1, 2, 3, 4)
                UNION ALL
                SELECT chapter_num, idx, round(least(duration, we + coalesce(CASE WHEN n[1] - f < 35 THEN least(35, n[2] - f) END, 0) * 0.01::DOUBLE), 3)
                FROM (SELECT h.chapter_num, idx, we, duration, f, min(CASE WHEN f1 > f THEN [f0, f1] END) AS n FROM (SELECT *, {frame('we')} AS f FROM pt WHERE is_last AND manual IS NULL) h LEFT JOIN isl ON isl.chapter_num = h.chapter_num GROUP BY 1, 2, 3, 4, 5)""",
    "near": """SELECT g.*, greatest(s, lo) AS s0, least(e, hi) AS s1, s AS quiet FROM (
                 SELECT *, greatest(0.0::DOUBLE, least(we, mid) - 4) AS lo, least(duration, greatest(ws, mid) + 4) AS hi FROM (SELECT *, (we + ws) / 2 AS mid FROM pt WHERE NOT is_first AND NOT is_last AND manual IS NULL)) g
               LEFT JOIN (SELECT * FROM sil WHERE e - s >= 0.1::DOUBLE) q ON q.chapter_num = g.chapter_num AND e > lo AND s < hi""",
    "snap": f"""SELECT chapter_num, idx, {r3('coalesce(b.spot, mid)')} AS cut, {r3('coalesce(least(greatest(b.score, 0.0::DOUBLE), 1.0::DOUBLE), 0.0)')} AS confidence, CASE WHEN b IS NULL THEN 'words' ELSE 'silence' END AS source,
               {r3('coalesce(b.s0, 0.0)')} AS silence_start, {r3('coalesce(b.s1, 0.0)')} AS silence_end
               FROM (SELECT chapter_num, idx, mid, arg_max({{'spot': spot, 'score': score, 's0': s0, 's1': s1}}, [score, -quiet]) FILTER (s1 - s0 >= 0.1::DOUBLE) AS b
                     FROM (SELECT *, least(s1 - s0, 0.5::DOUBLE) / 0.5::DOUBLE - 0.8::DOUBLE * abs(spot - mid) / 4 AS score FROM (SELECT *, s0 + 0.5::DOUBLE * (s1 - s0) AS spot FROM near)) GROUP BY 1, 2, 3)""",
    "tm": """SELECT pt.*, coalesce(manual, edge, cut) AS t, CASE WHEN manual IS NOT NULL THEN 'manual' WHEN edge IS NOT NULL THEN 'edge' ELSE source END AS source,
             CASE WHEN manual IS NOT NULL OR edge IS NOT NULL THEN 1.0::DOUBLE ELSE confidence END AS confidence, coalesce(silence_start, 0.0) AS silence_start, coalesce(silence_end, 0.0) AS silence_end
             FROM pt LEFT JOIN edge ON edge.chapter_num = pt.chapter_num AND edge.idx = pt.idx LEFT JOIN snap ON snap.chapter_num = pt.chapter_num AND snap.idx = pt.idx""",
    "safe": f"""SELECT chapter_num, idx, CASE WHEN coalesce(a, 0) > 0 THEN least(coalesce(b, 0) * 0.01::DOUBLE, coalesce(a, 0) * 0.01::DOUBLE) ELSE 0 END AS safety
                FROM (SELECT h.chapter_num, idx, max(CASE WHEN f0 < f THEN least(60, f - f0) END) AS b, max(CASE WHEN f1 > f THEN least(60, f1 - f) END) AS a
                      FROM (SELECT *, {frame('t')} AS f FROM tm) h LEFT JOIN isl ON isl.chapter_num = h.chapter_num AND f0 <= f AND f1 >= f GROUP BY 1, 2)""",
    "pl": """SELECT *, CASE WHEN pushed > t + 1e-9 THEN greatest(t, round(least(pushed, duration), 3)) ELSE t END AS time
             FROM (SELECT *, max(t - idx * 0.2::DOUBLE) OVER (PARTITION BY chapter_num ORDER BY idx) + idx * 0.2::DOUBLE AS pushed FROM tm)""",
    "ct": """SELECT pl.chapter_num, pl.idx, key, round(time, 3) AS time, source, round(confidence, 3) AS confidence, round(safety, 3) AS safety, silence_start, silence_end, round(coalesce(we, 0.0), 3) AS word_end, round(coalesce(ws, duration), 3) AS word_start,
             said IS NOT NULL AS no_pause, coalesce(said, '') AS segment_text, abs(time - t) > 1e-9 AS clamped, said IS NOT NULL OR source = 'words' OR safety < 0.08::DOUBLE AS needs_attention
             FROM pl JOIN safe ON safe.chapter_num = pl.chapter_num AND safe.idx = pl.idx
             LEFT JOIN (SELECT pl.chapter_num, idx, arg_min(text, seg_id) AS said FROM pl JOIN seg ON seg.chapter_num = pl.chapter_num AND start + 0.05::DOUBLE < time AND time < "end" - 0.05::DOUBLE WHERE NOT is_first AND NOT is_last GROUP BY 1, 2) x
               ON x.chapter_num = pl.chapter_num AND x.idx = pl.idx""",
    "tb": f"""SELECT un.chapter_num, CAST(unit_idx + 1 AS INTEGER) AS chunk_id, text, CASE WHEN kind = 'insert' THEN 'intro_outro' WHEN dialogue THEN 'dialogue' ELSE 'narration' END AS chunk_type, {wrap_sql('text')} AS lines_count, start_time, end_time,
              round(end_time - start_time, 3) AS duration, cut_key, kind, token_start, token_end, anchor, insert_board, edited, corrected
              FROM un JOIN (SELECT chapter_num, idx, time AS start_time, lead(time) OVER (PARTITION BY chapter_num ORDER BY idx) AS end_time FROM ct) c ON c.chapter_num = un.chapter_num AND idx = unit_idx""",
    "sm": """SELECT b.*, cuts, attention, no_pause, from_silence, from_words, manual, clamped FROM (
               SELECT chapter_num, count(*) AS boards, count(*) FILTER (kind = 'insert') AS inserts, count(*) FILTER (kind = 'insert' AND edited) AS inserts_edited, count(*) FILTER (corrected) AS corrections, count(*) FILTER (lines_count > 11) AS over_limit FROM tb GROUP BY 1) b
             JOIN (SELECT chapter_num, count(*) AS cuts, count(*) FILTER (needs_attention) AS attention, count(*) FILTER (no_pause) AS no_pause, count(*) FILTER (source = 'silence') AS from_silence, count(*) FILTER (source = 'words') AS from_words,
                          count(*) FILTER (source = 'manual') AS manual, count(*) FILTER (clamped) AS clamped FROM ct GROUP BY 1) c ON c.chapter_num = b.chapter_num""",
}


def steps(select: str, last: str) -> str:
    """``select`` after the steps up to ``last``."""
    names = list(STEPS)
    return "WITH " + ", ".join(f"{n} AS ({STEPS[n]})" for n in names[: names.index(last) + 1]) + " " + select


ORACLE_SQL["u1_heard_text"] = steps(
    """SELECT x.chapter_num, x.span_id, x.start, x."end", coalesce(string_agg(g.text, ' ' ORDER BY g.seg_id), '') AS heard
FROM (SELECT chapter_num, token_idx AS span_id, start - 8 AS start, "end" + 8 AS "end" FROM w) x LEFT JOIN seg g ON g.chapter_num = x.chapter_num AND g."end" > x.start + 0.1 AND g.start < x."end" - 0.1
GROUP BY x.chapter_num, x.span_id, x.start, x."end" """,
    "seg",
)
ORACLE_SQL["l13_bounds"] = f"""
SELECT chapter_num, CAST(token_idx // 7 AS INTEGER) AS board_idx, CAST(min(token_idx) AS INTEGER) AS lo, CAST(max(token_idx) + 1 AS INTEGER) AS hi FROM ({WORDS_SQL}) GROUP BY chapter_num, token_idx // 7
"""
ORACLE_SQL["u2_insert_units"] = steps("SELECT * FROM iu", "iu")
ORACLE_SQL["a12_insert_words"] = steps('SELECT chapter_num, anchor, k, word, s AS start, e AS "end" FROM it', "it")
ORACLE_SQL["u3_units"] = steps("SELECT * FROM un", "un")
ORACLE_SQL["u4_cuts"] = steps("SELECT * FROM ct", "ct")
ORACLE_SQL["u8_timed_boards"] = steps("SELECT * FROM tb", "tb")
ORACLE_SQL["u9_summary"] = steps("SELECT * FROM sm", "sm")
_COUNTERS = "boards inserts inserts_edited corrections over_limit cuts attention no_pause from_silence from_words manual clamped".split()
ORACLE_SQL["u11_totals"] = steps(f"SELECT chapter_num % 5 AS book, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _COUNTERS)} FROM sm GROUP BY 1", "sm")
