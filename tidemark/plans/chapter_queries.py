"""Chapter and layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import chapter_map as M
from tidemark.operators import chapters as C
from tidemark.operators import layouts as L
from tidemark.operators import timing as T
from tidemark.plans.timing_queries import WORDS_SQL
from tidemark.sources import recordings as R
from tidemark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def books(spark, sf_dir):
    """Each conversation is a book: every turn is a chapter under its number."""
    turns = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("Rozdział "), X.roman((F.col("turn") + 1).cast("int")), F.lit(". tura\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", part.alias("part"))))
    return turns.groupBy(F.col("conv_id").alias("book_id")).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("text"))


def _found(spark, sf_dir):
    own = books(spark, sf_dir)
    found = C.headings(own)
    return own, found, C.scores(found, own.select("book_id", F.lit(4).alias("expected")))


def c2_headings(spark, sf_dir):
    return _found(spark, sf_dir)[1]


def c4_scores(spark, sf_dir):
    return _found(spark, sf_dir)[2]


def c6_chapters(spark, sf_dir):
    _, found, scored = _found(spark, sf_dir)
    return C.chapters(found, C.best_pattern(scored))


def c7_anchors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.coalesce("text", F.lit("")).alias("text"))
    return M.anchors_anywhere(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("snippet_id"), "text"))


def _recordings(spark, sf_dir):
    """Recordings of the conversations' books: in most of them one a chapter, in some fewer or more, in some none."""
    turns = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("r"), F.format_string("%03d", "turn"), F.lit(".mp3"))
    own = turns.select(F.col("conv_id").alias("book_id"), name.alias("audio_file"), (F.length(F.coalesce("text", F.lit(""))) / 13.5 + 1).alias("duration"), F.slice(X.words(F.coalesce("text", F.lit(""))), 1, 30).alias("words"), "turn")
    return own.filter("book_id % 5 <> 4 and not (book_id % 5 = 3 and turn = 1)").drop("turn")


def _bare(spark, sf_dir):
    """The books; every third one without its headings."""
    return books(spark, sf_dir).withColumn("text", F.when(F.col("book_id") % 3 == 1, F.regexp_replace("text", "(?m)^Rozdział .*$", "")).otherwise(F.col("text")))


def c11_chapter_map(spark, sf_dir):
    rows = M.proposed(_bare(spark, sf_dir), _recordings(spark, sf_dir))
    return rows.withColumn("warnings", F.array_join("warnings", "|"))


def t10_search_map(spark, sf_dir):
    """Place in the text of each sign of its search form, counted and added up."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.search_places(F.coalesce("text", F.lit(""))).alias("p")).select("conv_id", "turn", F.array_join(F.col("p").cast("array<string>"), ",").alias("places"))


def c13_saved_map(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    entries = turns.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("nth"), (F.col("turn") % 3 + 1).alias("chapter_num"), (F.col("turn") * 91 % 700 - 50).alias("text_start"), (F.col("turn") * 300).alias("text_end"))
    return C.saved_map(entries, books(spark, sf_dir))


def ops(spark, sf_dir):
    """Events as edits of the layouts that their users' events make."""
    i, kind = F.col("token_idx"), F.col("token_idx") % 10
    names = F.array(*map(F.lit, ("split", "merge", "move", "cut_time", "reviewed", "correction", "insert_text", "insert_split", "insert_move", "insert_merge")))
    words = R.word_times(spark, sf_dir)
    own = words.select(
        F.col("chapter_num").cast("long").alias("chapter_num"), i.cast("long").alias("op_id"), F.element_at(names, kind + 1).alias("op"), F.concat(F.lit("b"), F.floor(i / 7) * 7).alias("key"),
        F.when(kind > 6, i % 2).otherwise(F.floor(i / 14)).cast("int").alias("board"), F.when(kind >= 6, F.lit(14)).when(kind == 5, F.floor(i / 7) * 7).otherwise(i).cast("int").alias("at"),
        F.when(kind == 5, F.floor(i / 7) * 7 + 7).otherwise(i % 5 + 1).cast("int").alias("until"), F.col("start").alias("value"), F.concat(F.lit("nowy tekst "), "word").alias("text"), F.lit(6).alias("n_words"),
    )
    return words, own


def l18_edits(spark, sf_dir):
    words, rows = ops(spark, sf_dir)
    chapters = words.groupBy(F.col("chapter_num").cast("long").alias("chapter_num")).agg(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "word"))), lambda x: x["word"]).alias("words"))
    state = chapters.join(R.layouts(words).select("chapter_num", "breaks"), "chapter_num")
    out = L.edited(state, rows)
    return out.withColumns({"breaks": F.array_join(F.col("breaks").cast("array<string>"), ","), "rejected": F.size("rejected")})


def l6_valid_cut_keys(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    at = F.col("token_idx")
    key = F.when(at % 4 == 1, F.concat(F.lit("i"), at, F.lit(".0"))).when(at % 4 == 2, "end").when(at % 4 == 3, F.concat(F.lit("x"), at)).otherwise(F.concat(F.lit("b"), at))
    return words.join(R.layouts(words), "chapter_num").select("chapter_num", "token_idx", L.valid_cut_key(key, F.col("breaks"), F.col("token_count")).alias("valid"))


def l8_stale_corrections(spark, sf_dir):
    words = R.word_times(spark, sf_dir)
    made = words.select("chapter_num", F.col("token_idx").alias("lo"), (F.col("token_idx") + 7).alias("hi"))
    return L.stale_corrections(made, T.bounds(R.layouts(words)))


QUERIES = {f.__name__: f for f in (c2_headings, c4_scores, c6_chapters, c7_anchors, c11_chapter_map, t10_search_map, c13_saved_map, l18_edits, l6_valid_cut_keys, l8_stale_corrections)}
ORACLE_SQL["t10_search_map"] = """
SELECT conv_id, turn, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k), '') AS places FROM (
  SELECT *, good OR coalesce(lag(good) OVER (PARTITION BY conv_id, turn ORDER BY k), false) AS kept FROM (
    SELECT conv_id, turn, k, regexp_matches(substr(t, CAST(k + 1 AS BIGINT), 1), '[\\p{L}\\p{N}]') AS good FROM (SELECT conv_id, turn, coalesce(text, '') AS t, unnest(range(length(coalesce(text, '')))) AS k FROM conversations)))
WHERE kept GROUP BY 1, 2
UNION ALL SELECT conv_id, turn, '' FROM conversations WHERE NOT regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}]')
"""
ORACLE_SQL["c13_saved_map"] = """
WITH b AS (SELECT conv_id AS book_id, sum(length('Rozdział ' || CASE turn WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' WHEN 3 THEN 'IV' WHEN 4 THEN 'V' WHEN 5 THEN 'VI' WHEN 6 THEN 'VII' ELSE 'VIII' END || '. tura' || chr(10) || coalesce(text, '') || chr(10))) AS n FROM conversations GROUP BY 1),
e AS (SELECT conv_id AS book_id, turn AS nth, turn % 3 + 1 AS chapter_num, least(greatest(turn * 91 % 700 - 50, 0), n) AS text_start, least(greatest(turn * 300, 0), n) AS text_end FROM conversations JOIN b ON b.book_id = conv_id),
p AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY text_start, nth) AS place FROM e),
a AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_num ORDER BY place) > 1 AS again FROM p)
SELECT book_id, place, CASE WHEN again THEN place ELSE chapter_num END AS chapter_num, CAST(text_start AS BIGINT) AS text_start, CAST(text_end AS BIGINT) AS text_end FROM a
"""
ORACLE_SQL["l6_valid_cut_keys"] = f"SELECT chapter_num, token_idx, CASE token_idx % 4 WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE token_idx % 7 = 0 END AS valid FROM ({WORDS_SQL})"
ORACLE_SQL["l8_stale_corrections"] = f"""
WITH w AS ({WORDS_SQL}), n AS (SELECT chapter_num, count(*) AS n FROM w GROUP BY 1)
SELECT w.chapter_num, CAST(token_idx AS INTEGER) AS lo, CAST(token_idx + 7 AS INTEGER) AS hi FROM w JOIN n ON n.chapter_num = w.chapter_num WHERE NOT (token_idx % 7 = 0 AND token_idx + 7 <= n)
"""

_BOOKS = """SELECT conv_id AS book_id, string_agg('Rozdział ' || ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII'][turn + 1] || '. tura' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn) AS text
FROM conversations GROUP BY 1"""
_NUMBERS = ", ".join(f"('{k}', {v})" for k, v in (C.ordinals() | {C.roman_value(n).lower(): n for n in range(1, 51)}).items())
_EDGE = "[ .:—–-]+"


def _pattern_sql(k: int, name: str, pattern: str) -> str:
    own = pattern.replace("(?iu)", "(?i)")
    return f"""SELECT book_id, n AS text_len, '{name}' AS pattern, {k} AS pattern_no, ms AS match_start, ms + length(line) AS body_start, s, nx, regexp_extract(line, '{own}', 1) AS token,
      regexp_replace(regexp_extract(line, '{own}', 2), '^{_EDGE}|{_EDGE}$', '', 'g') AS own_title FROM q WHERE regexp_matches(line, '{own}') AND s <> ''"""


_HEADINGS = f"""
l AS (SELECT book_id, n, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT book_id, length(text) AS n, string_split(text, chr(10)) AS ls FROM ({_BOOKS}))),
p AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS s, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY book_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ms FROM l),
q AS (SELECT *, first_value(CASE WHEN s <> '' THEN {{'ms': ms, 'line': s}} END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM p),
f AS ({' UNION ALL '.join(_pattern_sql(k, *x) for k, x in enumerate(C.PATTERNS))}),
t AS (SELECT *, CASE WHEN own_title <> '' THEN own_title
        WHEN nx.ms < body_start + {C.SHORT_SPAN} AND length(nx.line) <= 90 AND NOT regexp_matches(nx.line, '^[—–-]') AND NOT regexp_matches(nx.line, '[.!?:]$') THEN nx.line ELSE '' END AS title, regexp_replace(lower(trim(token)), '\\s+', ' ', 'g') AS low FROM f),
h AS (SELECT book_id, text_len, pattern, pattern_no, match_start, body_start, CASE WHEN contains(s, title) THEN s ELSE s || ' ' || title END AS header, CASE WHEN regexp_full_match(low, '\\d+') THEN TRY_CAST(low AS INTEGER) ELSE v END AS number, title,
        CAST(row_number() OVER (PARTITION BY book_id, pattern_no ORDER BY match_start) - 1 AS INTEGER) AS idx FROM t LEFT JOIN (VALUES {_NUMBERS}) m(word, v) ON word = low)"""
_SCORES = f"""
g AS (SELECT *, coalesce(lead(match_start) OVER o, text_len) - body_start AS span, coalesce(number > lag(number) OVER o, true) AS rises FROM h WINDOW o AS (PARTITION BY book_id, pattern_no ORDER BY match_start)),
c AS (SELECT book_id, pattern, pattern_no, count(*) AS n, count(number) = count(*) AND bool_and(rises) AS good, count(*) FILTER (span < {C.SHORT_SPAN}) AS tiny, avg(span) AS mean, stddev_pop(span) AS deviation FROM g GROUP BY 1, 2, 3),
r AS (SELECT book_id, pattern, pattern_no, n, round(3 * greatest(0.0, 1 - abs(n - 4) / 4.0::DOUBLE) + CASE WHEN good THEN 1.5 ELSE 0 END - 0.5::DOUBLE * tiny + CASE WHEN mean > 0 THEN greatest(0.0, 1.5 - deviation / mean) ELSE 0 END, 3) AS score FROM c WHERE n >= 2)"""
ORACLE_SQL["c2_headings"] = f"WITH {_HEADINGS} SELECT * FROM h"
ORACLE_SQL["c4_scores"] = f"WITH {_HEADINGS}, {_SCORES} SELECT * FROM r"
ORACLE_SQL["c6_chapters"] = f"""WITH {_HEADINGS}, {_SCORES},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, pattern_no) AS best FROM r WHERE score > 0) WHERE best = 1),
o AS (SELECT h.*, coalesce(number, idx + 1) AS raw, coalesce(lead(match_start) OVER (PARTITION BY h.book_id ORDER BY match_start), text_len) AS text_end FROM h JOIN b ON b.book_id = h.book_id AND b.pattern_no = h.pattern_no)
SELECT book_id, CAST(CASE WHEN row_number() OVER (PARTITION BY book_id, raw ORDER BY match_start) > 1 THEN idx + 1 ELSE raw END AS INTEGER) AS chapter_num, header, title, body_start AS text_start, text_end, 1.0::DOUBLE AS confidence FROM o
"""
