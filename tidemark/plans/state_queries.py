"""Queries of states, lists and earlier results, over events as recordings and conversations as chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import alignment as A
from tidemark.operators import layouts as L
from tidemark.operators import legacy as G
from tidemark.operators import signal
from tidemark.operators import states as S
from tidemark.operators import timing as T
from tidemark.operators import views as V
from tidemark.plans import signal_queries, timing_queries, view_queries
from tidemark.plans.segment_queries import BLOCKS_SQL
from tidemark.plans.text_queries import wrap_sql
from tidemark.plans.timing_queries import steps
from tidemark.sources import recordings as R
from tidemark.sources.scratch import materialise
from tidemark.sources.tables import dialogue_chapters

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _tokens(words):
    return words.select("chapter_num", "token_idx", "word", F.lit(" ").alias("sep"), F.col("matched").alias("is_dialogue"))


def _manual(words):
    at = words.filter("token_idx % 21 = 0")
    return at.select("chapter_num", F.concat(F.lit("b"), "token_idx").alias("key"), F.round(F.col("start") + 0.1, 3).alias("manual"))


_DERIVED = f"""
SELECT chapter_num, CAST(board + 1 AS INTEGER) AS chunk_id, text, CASE WHEN dialogue THEN 'dialogue' ELSE 'narration' END AS chunk_type, {wrap_sql('text')} AS lines_count, s AS start_time, e AS end_time, round(e - s, 3) AS duration,
       lo AS token_start, hi AS token_end, lo % 21 = 0 AS manual_start, n0 IS NOT NULL AS manual_end
FROM (SELECT bb.*, n.start AS n0, round(CASE WHEN lo % 21 = 0 THEN round(first_start + 0.1::DOUBLE, 3) ELSE first_start END, 3) AS s, round(coalesce(round(n.start + 0.1::DOUBLE, 3), last_end), 3) AS e
      FROM bb LEFT JOIN w n ON n.chapter_num = bb.chapter_num AND n.token_idx = hi AND hi % 21 = 0)
"""


@query(steps(_DERIVED, "bb"))
def l14_derived_boards(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    return S.derived_boards(R.layouts(words), _tokens(words), words, _manual(words))


def _chapters(spark, sf_dir):
    """Stored boards of all conversations, and boards that a layout gives to two thirds of them."""
    stored = view_queries.boards(spark, sf_dir)
    return stored.filter("chapter_num % 3 <> 0").withColumn("end_time", F.col("end_time") + 0.05), stored


_VIEW = f"""
SELECT * EXCLUDE (end_time), CASE WHEN chapter_num % 3 <> 0 THEN end_time + 0.05::DOUBLE ELSE end_time END AS end_time, CASE WHEN chapter_num % 3 <> 0 THEN 'layout' ELSE 'legacy' END AS {{0}} FROM ({view_queries.BOARDS_SQL})
"""


@query(_VIEW.format("board_source"))
def v1_chapter_view(spark, sf_dir):
    return S.derived_or_stored(*_chapters(spark, sf_dir))


@query(f"""SELECT book_id, count(*) AS chapters, count(*) FILTER (legacy) AS degraded, bool_and(legacy) AS refused
FROM (SELECT book_id, chapter_num, bool_or(cut_source = 'legacy') AS legacy FROM ({_VIEW.format('cut_source')}) GROUP BY 1, 2) GROUP BY 1""")
def x7_export_state(spark, sf_dir):
    return S.export_state(S.derived_or_stored(*_chapters(spark, sf_dir), "cut_source"))


def _layouts(words):
    own = words.groupBy("chapter_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "word"))), lambda x: x["word"]).alias("ws"))
    return R.layouts(words).join(own.select("chapter_num", X.words_hash(F.col("ws")).alias("text_hash")), "chapter_num").withColumn("saved", F.col("chapter_num") % 2 == 0)


def _reviewed(words):
    return words.filter("token_idx % 28 = 0").select("chapter_num", F.concat(F.lit("b"), "token_idx").alias("key"))


_RECORDED = "chapter_num % 4 <> 1"


@query(steps(f"""SELECT l.chapter_num, token_count, breaks, text_hash, l.chapter_num % 2 = 0 AS saved, coalesce(flags, '') AS flags, f.chapter_num IS NOT NULL AS processed, coalesce(i.inserts, 0) AS inserts, coalesce(reviewed, '') AS reviewed,
  coalesce(stale, '') AS stale, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) AS errors
FROM (SELECT w.chapter_num, CAST(count(*) AS INTEGER) AS token_count, coalesce(string_agg(CAST(token_idx AS VARCHAR), ',' ORDER BY token_idx) FILTER (token_idx % 7 = 0 AND token_idx > 0), '') AS breaks,
             substr(sha1(string_agg(word, chr(10) ORDER BY token_idx)), 1, 16) AS text_hash FROM w GROUP BY 1) l
LEFT JOIN (SELECT chapter_num, string_agg(CASE WHEN no_pause THEN key || ':' || segment_text END, '|' ORDER BY idx) AS flags FROM ct WHERE {_RECORDED} GROUP BY 1) f ON f.chapter_num = l.chapter_num
LEFT JOIN (SELECT chapter_num, count(DISTINCT anchor) AS inserts FROM iu GROUP BY 1) i ON i.chapter_num = l.chapter_num
LEFT JOIN (SELECT chapter_num, string_agg('b' || token_idx, ',' ORDER BY 'b' || token_idx) AS reviewed FROM w WHERE token_idx % 28 = 0 GROUP BY 1) r ON r.chapter_num = l.chapter_num
LEFT JOIN (SELECT chapter_num, string_agg(token_idx || '-' || (token_idx + 7), ',' ORDER BY token_idx) AS stale FROM w WHERE token_idx % 35 = 3 GROUP BY 1) g ON g.chapter_num = l.chapter_num
LEFT JOIN (SELECT chapter_num, count(*) FILTER ({wrap_sql('text')} > 1) AS warnings, count(*) FILTER ({wrap_sql('text')} = 0) AS errors FROM bb GROUP BY 1) o ON o.chapter_num = l.chapter_num""", "ct"))
def v2_layout_state(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    cuts = timing_queries.u4_cuts(spark, sf_dir).filter(_RECORDED)
    made = words.filter("token_idx % 35 = 3").select("chapter_num", F.col("token_idx").alias("lo"), (F.col("token_idx") + 7).alias("hi"))
    stale = L.stale_corrections(made, T.bounds(R.layouts(words)))
    boards = R.book_boards(words).select("chapter_num", X.line_count(F.col("text")).alias("lines_count"))
    return S.layout_state(_layouts(words), cuts, timing_queries.u2_insert_units(spark, sf_dir), _reviewed(words), stale, boards, 1)


_STATE = """
SELECT ct.*, r.key IS NOT NULL AS reviewed, CASE WHEN r.key IS NOT NULL THEN 'reviewed' WHEN needs_attention THEN 'attention' WHEN source = 'manual' THEN 'manual' ELSE 'automatic' END AS state
FROM ct LEFT JOIN (SELECT chapter_num, 'b' || token_idx AS key FROM w WHERE token_idx % 28 = 0) r ON r.chapter_num = ct.chapter_num AND r.key = ct.key
"""


@query(steps(_STATE, "ct"))
def v3_cut_state(spark, sf_dir):
    return S.cut_state(timing_queries.u4_cuts(spark, sf_dir), _reviewed(R.word_times(spark, sf_dir)))


@query(steps(f"""SELECT chapter_num, count(*) FILTER (needs_attention AND NOT reviewed) AS "open", count(*) FILTER (reviewed) AS reviewed, coalesce(min(idx) FILTER (needs_attention AND NOT reviewed AND idx > 0 AND idx < m), 1) AS selected
FROM (SELECT *, max(idx) OVER (PARTITION BY chapter_num) AS m FROM ({_STATE})) GROUP BY 1""", "ct"))
def w4_open_cuts(spark, sf_dir):
    return S.open_cuts(v3_cut_state(spark, sf_dir))


@query(steps("""SELECT chapter_num, round(least(greatest(time + (idx % 3 - 1) * 0.7::DOUBLE, before + 0.2::DOUBLE), after - 0.2::DOUBLE), 3) AS time, idx
FROM (SELECT *, lag(time) OVER o AS before, lead(time) OVER o AS after FROM ct WINDOW o AS (PARTITION BY chapter_num ORDER BY idx)) WHERE before IS NOT NULL AND after IS NOT NULL""", "ct"))
def w5_moved_cuts(spark, sf_dir):
    cuts = timing_queries.u4_cuts(spark, sf_dir)
    return S.moved_cuts(cuts, cuts.select("chapter_num", "idx", (F.col("time") + (F.col("idx") % 3 - 1) * 0.7).alias("t")))


@query(steps(f"""SELECT c.chapter_num, coalesce(l.saved, false) AS saved_layout, s.chapter_num IS NOT NULL AS processed, CAST(coalesce(s.boards, l.laid) AS BIGINT) AS boards, attention, coalesce(reviewed, 0) AS reviewed,
  CAST(CASE WHEN c.chapter_num % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS archived_layouts, CASE WHEN l.laid IS NULL THEN 'no layout' END AS error
FROM (SELECT DISTINCT chapter_num FROM w) c
LEFT JOIN (SELECT chapter_num, chapter_num % 2 = 0 AS saved, count(*) AS laid FROM bb WHERE chapter_num % 5 <> 2 GROUP BY 1) l ON l.chapter_num = c.chapter_num
LEFT JOIN (SELECT * FROM sm WHERE {_RECORDED}) s ON s.chapter_num = c.chapter_num
LEFT JOIN (SELECT chapter_num, count(*) AS reviewed FROM w WHERE token_idx % 28 = 0 GROUP BY 1) r ON r.chapter_num = c.chapter_num""", "sm"))
def v4_state_overview(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    layouts, chapters = _layouts(words).filter("chapter_num % 5 <> 2"), words.select("chapter_num").distinct()
    return S.overview(chapters, layouts, timing_queries.u9_summary(spark, sf_dir).filter(_RECORDED), _reviewed(words), chapters.filter("chapter_num % 6 = 0"))


_PEAKS = f"({signal_queries.ORACLE_SQL['e10_peaks']})"
_BYTE = lambda c: f"string_agg(format('{{:02x}}', (CAST({c} AS INTEGER) + 256) % 256), '' ORDER BY bucket)"


@query(f"SELECT chapter_num, CAST(count(*) AS INTEGER) AS buckets, to_base64(unhex({_BYTE('lo')})) AS min, to_base64(unhex({_BYTE('hi')})) AS max FROM {_PEAKS} GROUP BY 1")
def v5_packed_peaks(spark, sf_dir):
    return S.packed_peaks(signal_queries.e10_peaks(spark, sf_dir))


@query(f"SELECT chapter_num, 118 / greatest(max(CAST(hi AS INTEGER)), max(-CAST(lo AS INTEGER)), 1)::DOUBLE AS gain FROM {_PEAKS} GROUP BY 1")
def w6_gain(spark, sf_dir):
    return S.gain(signal_queries.e10_peaks(spark, sf_dir))


@query(f"""SELECT x.chapter_num, x.x, least(0, coalesce(min(CAST(lo AS INTEGER)), 0)) AS lo, greatest(0, coalesce(max(CAST(hi AS INTEGER)), 0)) AS hi
FROM (SELECT *, i0 + span * x // 3 AS a, greatest(i0 + span * x // 3 + 1, i0 + span * (x + 1) // 3) AS b FROM (
  SELECT chapter_num, CAST(floor(0.3::DOUBLE * 2) AS INTEGER) AS i0, least(n, CAST(ceil(1.7::DOUBLE * 2) AS INTEGER)) AS i1, greatest(1, least(n, CAST(ceil(1.7::DOUBLE * 2) AS INTEGER)) - CAST(floor(0.3::DOUBLE * 2) AS INTEGER)) AS span, CAST(unnest(range(3)) AS INTEGER) AS x
  FROM (SELECT chapter_num, max(bucket) + 1 AS n FROM {_PEAKS} GROUP BY 1))) x
LEFT JOIN {_PEAKS} p ON p.chapter_num = x.chapter_num AND bucket >= a AND bucket < least(b, i1) GROUP BY 1, 2""")
def w7_peak_columns(spark, sf_dir):
    peaks = signal_queries.e10_peaks(spark, sf_dir)
    views = peaks.select("chapter_num").distinct().withColumns({"t0": F.lit(0.3), "t1": F.lit(1.7), "width": F.lit(3)})
    return S.peak_columns(peaks, views, 2.0)


@query(steps("""SELECT x.chapter_num, x.token_idx AS span_id, x.start, x."end", coalesce(string_agg(g.text, ' ' ORDER BY g.seg_id), '') AS heard
FROM w x LEFT JOIN seg g ON g.chapter_num = x.chapter_num AND NOT (g."end" < x.start OR g.start > x."end") GROUP BY 1, 2, 3, 4""", "seg"))
def w8_overlapping(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    return V.overlapping(words.select("chapter_num", F.col("token_idx").alias("span_id"), "start", "end"), R.segments(words))


def _payloads(spark, sf_dir):
    per = view_queries.boards(spark, sf_dir).filter("chapter_num % 3 <> 0").groupBy("book_id", "chapter_num").agg(F.max("end_time").alias("duration"), F.count(F.lit(1)).alias("chunks_count"))
    return per.withColumn("match_rate", F.round(F.col("chapter_num") % 101, 2))


_MADE = f"SELECT book_id, chapter_num, max(end_time) AS duration, count(*) AS chunks_count, chapter_num % 101 AS match_rate FROM ({view_queries.BOARDS_SQL}) WHERE chapter_num % 3 <> 0 GROUP BY ALL"


@query(f"""SELECT c.book_id, c.chapter_num, 'Rozdział ' || c.chapter_num AS header, c.blocks_count, CASE WHEN c.chapter_num % 2 = 0 THEN 'a' || c.chapter_num || '.mp3' END AS audio_file, m.chapter_num IS NOT NULL AS is_processed, duration, coalesce(chunks_count, 0) AS chunks_count, match_rate
FROM (SELECT book_id, chapter_num, CAST(count(*) AS INTEGER) AS blocks_count FROM ({BLOCKS_SQL}) GROUP BY ALL) c LEFT JOIN ({_MADE}) m ON m.chapter_num = c.chapter_num""")
def v6_chapter_list(spark, sf_dir):
    chapters = dialogue_chapters(spark, sf_dir).withColumn("header", F.concat(F.lit("Rozdział "), F.col("chapter_num").cast("string")))
    files = chapters.filter("chapter_num % 2 = 0").select("book_id", "chapter_num", F.concat(F.lit("a"), F.col("chapter_num").cast("string"), F.lit(".mp3")).alias("audio_file"))
    return S.chapter_list(chapters, _payloads(spark, sf_dir), files)


@query(f"""SELECT book_id, count(*) FILTER (chapter_num % 2 = 0) AS audio_count, CASE WHEN count(*) FILTER (chapter_num % 2 = 0) > 1 THEN 'multi' ELSE 'single' END AS audio_mode, count(*) AS chapter_map_count, count(*) FILTER (chapter_num % 3 <> 0) AS processed_count
FROM (SELECT DISTINCT book_id, chapter_num FROM ({view_queries.BOARDS_SQL})) GROUP BY 1""")
def v7_project_summary(spark, sf_dir):
    entries = view_queries.boards(spark, sf_dir).select("book_id", "chapter_num").distinct()
    return S.project_summary(entries, entries.filter("chapter_num % 2 = 0"), _payloads(spark, sf_dir))


@query(f"""SELECT * EXCLUDE (n, seen) FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY seen, sha1('2:' || chapter_num || ':' || chunk_id)) AS n FROM (
  SELECT b.*, coalesce(lag(chunk_id) OVER o, -1) AS previous, coalesce(lead(chunk_id) OVER o, -1) AS next,
         CASE WHEN EXISTS (SELECT 1 FROM ({view_queries.REVIEWS_SQL}) r WHERE r.chapter_num = b.chapter_num AND (r.cut_key = b.cut_key OR r.chunk_id = b.chunk_id)) THEN 1 ELSE 0 END AS seen
  FROM ({view_queries.BOARDS_SQL}) b WINDOW o AS (PARTITION BY book_id, chapter_num ORDER BY chunk_id))) WHERE n = 1""")
def v8_fresh_sample(spark, sf_dir):
    return V.sample(view_queries.boards(spark, sf_dir), 2, view_queries.reviews(spark, sf_dir))


@query(steps("""SELECT e.chapter_num, e.chunk_id AS op_id, CASE WHEN e.chunk_id % 5 = 0 AND e.chunk_id % 3 <> 0 THEN 'rejected' WHEN kind = 'insert' THEN 'insert_text' ELSE 'correction' END AS op,
  CASE WHEN e.chunk_id % 5 = 0 AND e.chunk_id % 3 <> 0 THEN NULL WHEN kind = 'insert' THEN anchor ELSE token_start END AS at, CASE WHEN e.chunk_id % 5 = 0 AND e.chunk_id % 3 <> 0 OR kind = 'insert' THEN NULL ELSE token_end END AS until, 'new ' || text AS text
FROM tb e""", "tb"))
def l19_text_edits(spark, sf_dir):
    boards = materialise(timing_queries.u8_timed_boards(spark, sf_dir), "boards")
    n = F.col("chunk_id")
    key = F.when(n % 3 == 0, F.lit(None)).when(n % 5 == 0, "b999999").otherwise(F.col("cut_key"))
    edits = boards.select("chapter_num", n.alias("op_id"), key.alias("cut_key"), "chunk_id", F.concat(F.lit("new "), "text").alias("text"))
    return S.text_edits(edits, boards)


def _heard(words):
    """Words heard, of which the first three, the last ones and some runs match nothing."""
    hit = F.when((F.col("token_idx") % 20 < 12) & (F.col("token_idx") > 2), F.col("token_idx"))
    return words.select("chapter_num", F.col("token_idx").alias("heard_idx"), "start", "end", hit.alias("token_idx"))


_EDGES = """SELECT chapter_num, side, arg_min(start, token_idx) AS start, arg_max("end", token_idx) AS "end", round(arg_max("end", token_idx) - arg_min(start, token_idx), 3) AS duration
FROM (SELECT *, CASE WHEN token_idx < a THEN 'intro' WHEN token_idx > z THEN 'outro' END AS side
      FROM (SELECT *, min(CASE WHEN token_idx % 20 < 12 AND token_idx > 2 THEN token_idx END) OVER p AS a, max(CASE WHEN token_idx % 20 < 12 AND token_idx > 2 THEN token_idx END) OVER p AS z FROM w WINDOW p AS (PARTITION BY chapter_num)))
WHERE side IS NOT NULL GROUP BY 1, 2 HAVING arg_max("end", token_idx) - arg_min(start, token_idx) >= 1.0"""


@query(steps(f"""SELECT e.chapter_num, side, CASE WHEN h IS NULL THEN '' ELSE h || chr(10) END || '(brak tekstu w pliku txt)' AS text, 'intro_outro' AS chunk_type, CASE WHEN h IS NULL THEN 1 ELSE 2 END AS lines_count,
  round(e.start, 3) AS start_time, round(e."end", 3) AS end_time, duration
FROM (SELECT e.*, string_agg(g.text, ' ' ORDER BY g.seg_id) AS h FROM ({_EDGES}) e LEFT JOIN seg g ON g.chapter_num = e.chapter_num AND g."end" > e.start + 0.1::DOUBLE AND g.start < e."end" - 0.1::DOUBLE GROUP BY ALL) e""", "seg"))
def a7_edge_boards(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    return G.edge_boards(G.edge_spans(_heard(words)), R.segments(words))


@query(steps(f"""SELECT c.chapter_num, coalesce(max(duration) FILTER (side = 'intro'), 0) AS intro_duration, coalesce(max(duration) FILTER (side = 'outro'), 0) AS outro_duration,
  coalesce(max(duration) FILTER (side = 'intro'), 0) > 0 AS intro_detected, coalesce(max(duration) FILTER (side = 'outro'), 0) > 0 AS outro_detected
FROM (SELECT DISTINCT chapter_num FROM w) c LEFT JOIN ({_EDGES}) e ON e.chapter_num = c.chapter_num GROUP BY 1""", "w"))
def a9_edge_flags(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    return G.edge_flags(G.edge_spans(_heard(words)), words.select("chapter_num").distinct())


@query(steps("SELECT chapter_num, count(*) AS untimed FROM w WHERE NOT matched GROUP BY 1", "w"))
def a10_untimed(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    return G.untimed(words.withColumn("start", F.when(F.col("matched"), F.col("start"))))


@query(steps('SELECT chapter_num, CAST(token_idx AS INTEGER) AS token_idx, start, "end" FROM w WHERE chapter_num % 7 <> 3 UNION ALL SELECT DISTINCT chapter_num, NULL::INTEGER, NULL::DOUBLE, NULL::DOUBLE FROM w WHERE chapter_num % 7 = 3', "w"))
def a13_payload_times(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    ws = F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "start", "end"))), lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e")))
    payloads = words.groupBy("chapter_num").agg(ws.alias("words")).withColumn("words", F.when(F.col("chapter_num") % 7 != 3, F.col("words")))
    return G.payload_times(payloads)


@query(steps("SELECT chapter_num, idx AS point_id, edge FROM edge", "edge"))
def e9_edge_cuts(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    units = timing_queries.u3_units(spark, sf_dir)
    ends = units.groupBy("chapter_num").agg(F.min_by("first_start", "unit_idx").alias("head"), F.max_by("last_end", "unit_idx").alias("tail"), (F.max("unit_idx") + 1).alias("last"))
    heads = ends.select("chapter_num", F.lit(0).alias("point_id"), F.col("head").alias("t"))
    return signal.edge_cuts(heads, ends.select("chapter_num", F.col("last").alias("point_id"), F.col("tail").alias("t")), R.islands(words), R.stats(words), R.HOP_S)


#: Stored boards, and the proposed cuts between them: as the steps above, with the boards in place of the units.
_STORED = timing_queries.STEPS | {
    "pt": """SELECT p.*, duration, n_frames, idx = -1 AS is_first, idx = last AS is_last, NULL::DOUBLE AS manual FROM (
               SELECT chapter_num, board AS idx, last_end AS we, lead(first_start) OVER o AS ws, max(board) OVER (PARTITION BY chapter_num) AS last FROM bb WINDOW o AS (PARTITION BY chapter_num ORDER BY board)
               UNION ALL SELECT chapter_num, -1, NULL, arg_min(first_start, board), max(board) FROM bb GROUP BY 1) p JOIN st ON st.chapter_num = p.chapter_num""",
    "rf": """SELECT chapter_num, idx AS point_id, cut, CASE WHEN source = 'words' THEN 'midpoint' ELSE 'silence' END AS method FROM snap UNION ALL SELECT chapter_num, idx, edge, 'edge' FROM edge""",
    "go": """SELECT bb.chapter_num, board AS idx, first_start AS s, last_end AS e, lead(last_end) OVER (PARTITION BY bb.chapter_num ORDER BY board) AS ne, c.cut FROM bb LEFT JOIN (SELECT * FROM rf WHERE method <> 'edge') c ON c.chapter_num = bb.chapter_num AND point_id = board""",
    "ap": """SELECT chapter_num, idx, CAST(NULL AS DOUBLE) AS moved, s + 0.05::DOUBLE < cut AND cut < ne - 0.05::DOUBLE AS taken, s, e, cut FROM go WHERE idx = 0
             UNION ALL SELECT g.chapter_num, g.idx, CASE WHEN ap.taken THEN ap.cut END, coalesce(CASE WHEN ap.taken THEN ap.cut END, g.s) + 0.05::DOUBLE < g.cut AND g.cut < g.ne - 0.05::DOUBLE, g.s, g.e, g.cut FROM ap JOIN go g ON g.chapter_num = ap.chapter_num AND g.idx = ap.idx + 1""",
}
_REFINING = "w st sil isl bb pt edge near snap rf".split()


def _refining(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_STORED[n]})" for n in [*_REFINING, *more]) + " " + select


def _stored(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    boards = R.book_boards(words).select("chapter_num", F.floor(F.col("lo") / R.BOARD).cast("int").alias("idx"), F.col("first_start").alias("start_time"), F.col("last_end").alias("end_time"))
    quiet = R.silence(words).filter(f"end - start >= {timing_queries.LEAST}")
    return boards, G.refined(boards, quiet, R.islands(words), R.stats(words), R.HOP_S, timing_queries.SEARCH, timing_queries.LEAST)


@query(_refining("SELECT * FROM rf"))
def e12_refined(spark, sf_dir):
    return _stored(spark, sf_dir)[1]


@query(_refining("""SELECT chapter_num, idx, start_time, end_time, round(end_time - start_time, 3) AS duration, cut_taken FROM (
  SELECT *, CASE WHEN lead(idx) OVER o IS NULL THEN round(greatest(tail, start_time + 0.05::DOUBLE), 3) ELSE own_end END AS end_time FROM (
    SELECT *, CASE WHEN idx = 0 THEN round(least(head, own_end - 0.05::DOUBLE), 3) ELSE coalesce(moved, s) END AS start_time FROM (
      SELECT ap.chapter_num, ap.idx, s, moved, CASE WHEN taken THEN cut ELSE e END AS own_end, coalesce(taken, false) AS cut_taken, h.edge AS head, t.edge AS tail
      FROM ap JOIN (SELECT * FROM edge WHERE idx = -1) h ON h.chapter_num = ap.chapter_num JOIN (SELECT * FROM edge WHERE idx >= 0) t ON t.chapter_num = ap.chapter_num))
  WINDOW o AS (PARTITION BY chapter_num ORDER BY idx))""", "go", "ap"))
def e13_applied(spark, sf_dir):
    return G.applied(*_stored(spark, sf_dir))


_AS_STORED = f"""SELECT chapter_num, chunk_id - 1 AS idx, CASE WHEN chunk_id % 9 = 0 THEN text || '!' ELSE text END AS text, start_time + CASE chunk_id % 4 WHEN 1 THEN 0.3::DOUBLE ELSE 0 END AS start_time,
  CASE WHEN chunk_id % 4 = 2 THEN start_time + 0.5::DOUBLE ELSE end_time END AS end_time FROM ({_DERIVED})"""


@query(steps(f"""SELECT chapter_num, count(*) AS boards, count(*) FILTER (o.text <> d.text) AS text_diff, count(*) FILTER (exact) AS exact, count(*) FILTER (NOT exact AND start_ok AND end_ok AND ds >= 0.002) AS clamped,
  count(*) FILTER (NOT exact AND start_ok AND end_ok AND stretched) AS min_duration, count(*) FILTER (NOT (start_ok AND end_ok)) AS unexplained
FROM (SELECT d.chapter_num, d, o, abs(d.start_time - o.start_time) AS ds, abs(d.end_time - o.end_time) AS de, abs(d.start_time - o.start_time) < 0.002 OR coalesce(abs(o.start_time - o.before) < 0.002, false) AS start_ok,
        abs(d.end_time - o.end_time) >= 0.002 AND abs(o.end_time - (o.start_time + 0.5::DOUBLE)) < 0.002 AS stretched,
        abs(d.end_time - o.end_time) < 0.002 OR abs(d.end_time - o.end_time) >= 0.002 AND abs(o.end_time - (o.start_time + 0.5::DOUBLE)) < 0.002 AS end_ok, abs(d.start_time - o.start_time) < 0.002 AND abs(d.end_time - o.end_time) < 0.002 AS exact
      FROM (SELECT *, chunk_id - 1 AS idx FROM ({_DERIVED})) d
      JOIN (SELECT *, coalesce(lag(end_time) OVER (PARTITION BY chapter_num ORDER BY idx), 0.0) AS before FROM ({_AS_STORED})) o ON o.chapter_num = d.chapter_num AND o.idx = d.idx) GROUP BY 1""", "bb"))
def l20_times_compared(spark, sf_dir):
    """Stored boards behind an intro that ends at 0."""
    derived = l14_derived_boards(spark, sf_dir)
    n = F.col("chunk_id")
    stored = derived.select(
        "chapter_num", n.alias("place"), F.lit("narration").alias("chunk_type"), F.when(n % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"),
        (F.col("start_time") + F.when(n % 4 == 1, 0.3).otherwise(0.0)).alias("start_time"), F.when(n % 4 == 2, F.col("start_time") + 0.5).otherwise(F.col("end_time")).alias("end_time"),
    )
    intro = derived.select("chapter_num").distinct().select("chapter_num", F.lit(0).alias("place"), F.lit("intro_outro").alias("chunk_type"), F.lit("x").alias("text"), F.lit(-1.0).alias("start_time"), F.lit(0.0).alias("end_time"))
    own = derived.select("chapter_num", (n - 1).alias("idx"), "text", "start_time", "end_time")
    return G.times_compared(own, stored.unionByName(intro))


@query(steps("""SELECT chapter_num, string_agg(word, ' ' ORDER BY token_idx) AS snippet FROM w WHERE start < 45 GROUP BY 1""", "w"))
def s10_snippets(spark, sf_dir):
    return A.snippets(R.word_times(spark, sf_dir))


@query(steps("""SELECT chapter_num, CAST(token_idx // 5 AS INTEGER) AS seg_id, CAST(token_idx % 5 AS INTEGER) AS word_idx, word, start, "end" FROM w""", "w"))
def s10_flattened(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    ws = F.array_sort(F.collect_list(F.struct("token_idx", "word", "start", "end")))
    segments = words.groupBy("chapter_num", F.floor(F.col("token_idx") / 5).cast("int").alias("seg_id")).agg(ws.alias("words"))
    return A.flattened(segments)
