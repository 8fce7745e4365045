"""Segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import segments as S
from tidemark.plans.text_queries import TRIM_SQL, WORDS_SQL, sentences_sql, wrap_sql
from tidemark.sources.tables import dialogue_chapters, document_chapters

QUERIES, ORACLE_SQL = {}, {}

CHAPTERS_SQL = """
SELECT 'book' || (conv_id % 7) AS book_id, conv_id AS chapter_num,
       string_agg(CASE WHEN role = 'user' THEN '— ' ELSE '' END || replace(coalesce(text, ''), chr(10), ' ') || CASE WHEN turn % 3 = 0 THEN chr(10) || chr(10) ELSE chr(10) END, '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
"""
_LINES = f"list_filter(list_transform(string_split(p, chr(10)), lambda l: {TRIM_SQL.format('l')}), lambda l: l <> '')"
_PARAS = f"list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {TRIM_SQL.format('x')}), lambda x: x <> '')"
_SAID = "regexp_matches({0}, '^[—–\\-―“„\"]')"


def blocks_sql(chapters: str) -> str:
    return f"""
SELECT book_id, chapter_num, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS block_idx, unnest(parts) AS text
FROM (SELECT book_id, chapter_num, flatten(list_transform({_PARAS}, lambda p: CASE WHEN len({_LINES}) > 1 AND len(list_filter({_LINES}, lambda l: {_SAID.format('l')})) > 0 THEN {_LINES} ELSE [p] END)) AS parts
      FROM ({chapters}))
"""


BLOCKS_SQL = blocks_sql(CHAPTERS_SQL)
DOCUMENTS_SQL = "SELECT source AS book_id, doc_id AS chapter_num, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS text FROM documents"


def boards_sql(chapters: str) -> str:
    """Boards in SQL: sentences of long blocks are packed one after the other, then neighbouring dialogue is joined."""
    said = _SAID.format("text")
    words = f"CAST(len({WORDS_SQL.format('text')}) AS INTEGER)"
    return f"""
WITH RECURSIVE block AS (SELECT *, {wrap_sql('text')} AS lines, {said} AS said FROM ({blocks_sql(chapters)})),
sentence AS (SELECT chapter_num, block_idx, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM (SELECT chapter_num, block_idx, {sentences_sql('text')} AS ss FROM block WHERE lines > 11)),
packed AS (
  SELECT chapter_num, block_idx, k, s AS own, 1 AS piece FROM sentence WHERE k = 1
  UNION ALL
  SELECT chapter_num, block_idx, k, CASE WHEN fits THEN whole ELSE s END, CASE WHEN fits THEN piece ELSE piece + 1 END
  FROM (SELECT *, {wrap_sql('whole')} <= 11 AS fits FROM (SELECT n.chapter_num, n.block_idx, n.k, n.s, p.piece, p.own || ' ' || n.s AS whole FROM packed p JOIN sentence n ON n.chapter_num = p.chapter_num AND n.block_idx = p.block_idx AND n.k = p.k + 1))
),
piece AS (
  SELECT chapter_num, text, lines, said, joins, row_number() OVER (PARTITION BY chapter_num ORDER BY block_idx, piece) AS n FROM (
    SELECT chapter_num, block_idx, 0 AS piece, text, lines, said, said AS joins FROM block WHERE lines <= 11
    UNION ALL SELECT x.chapter_num, x.block_idx, piece, text, {wrap_sql('text')}, said, false
    FROM (SELECT chapter_num, block_idx, piece, arg_max(own, k) AS text FROM packed GROUP BY 1, 2, 3) x JOIN (SELECT chapter_num, block_idx, said FROM block) b ON b.chapter_num = x.chapter_num AND b.block_idx = x.block_idx)
),
merged AS (
  SELECT chapter_num, n, text, lines, said, joins, 1 AS board FROM piece WHERE n = 1
  UNION ALL
  SELECT chapter_num, n, CASE WHEN one THEN before || chr(10) || text ELSE text END, CASE WHEN one THEN had + lines ELSE lines END, said, joins, CASE WHEN one THEN board ELSE board + 1 END
  FROM (SELECT q.*, m.text AS before, m.lines AS had, m.board, m.joins AND q.joins AND m.lines + q.lines <= 11 AS one FROM merged m JOIN piece q ON q.chapter_num = m.chapter_num AND q.n = m.n + 1)
)
SELECT book_id, m.chapter_num, CAST(board AS INTEGER) AS chunk_id, text, CASE WHEN said THEN 'dialogue' ELSE 'narration' END AS chunk_type, CAST(lines AS INTEGER) AS lines_count, {words} AS n_words
FROM (SELECT chapter_num, board, arg_max(text, n) AS text, arg_max(lines, n) AS lines, bool_and(said) AS said FROM merged GROUP BY 1, 2) m JOIN (SELECT DISTINCT book_id, chapter_num FROM block) c ON c.chapter_num = m.chapter_num
"""




def t4_blocks(spark, sf_dir):
    rows = S.blocks(dialogue_chapters(spark, sf_dir))
    return rows.withColumn("sentences", F.array_join("sentences", "|"))


QUERIES["t4_blocks"] = t4_blocks
ORACLE_SQL["t4_blocks"] = f"""SELECT *, {_SAID.format('text')} AS is_dialogue, {wrap_sql('text')} AS estimated_lines,
array_to_string({sentences_sql('text')}, '|') AS sentences FROM ({BLOCKS_SQL})"""

TOKENS_SQL = f"""
SELECT book_id, chapter_num, CAST(row_number() OVER (PARTITION BY chapter_num ORDER BY block_idx, k) - 1 AS INTEGER) AS token_idx, word,
       CASE WHEN row_number() OVER (PARTITION BY chapter_num ORDER BY block_idx DESC, k DESC) = 1 THEN '' WHEN k = n THEN chr(10) ELSE ' ' END AS sep, block_idx, is_dialogue
FROM (SELECT book_id, chapter_num, block_idx, {_SAID.format('text')} AS is_dialogue, unnest({WORDS_SQL.format('text')}) AS word,
             generate_subscripts({WORDS_SQL.format('text')}, 1) AS k, len({WORDS_SQL.format('text')}) AS n FROM ({BLOCKS_SQL}))
"""


def t13_tokens(spark, sf_dir):
    return S.tokens(dialogue_chapters(spark, sf_dir))


QUERIES["t13_tokens"] = t13_tokens
ORACLE_SQL["t13_tokens"] = f"""
SELECT *, char_start + CAST(length(word) AS INTEGER) AS char_end FROM (
  SELECT *, CAST(coalesce(sum(length(word) + length(sep)) OVER (PARTITION BY chapter_num ORDER BY token_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS char_start
  FROM ({TOKENS_SQL}))
"""


def t14_rendered(spark, sf_dir):
    return S.rendered(S.tokens(dialogue_chapters(spark, sf_dir)), *S.KEYS)


QUERIES["t14_rendered"] = t14_rendered
ORACLE_SQL["t14_rendered"] = f"""
SELECT book_id, chapter_num, string_agg(word || CASE WHEN last THEN '' ELSE sep END, '' ORDER BY token_idx) AS text, bool_and(is_dialogue) AS all_dialogue, CAST(count(*) AS INTEGER) AS n
FROM (SELECT *, token_idx = max(token_idx) OVER (PARTITION BY chapter_num) AS last FROM ({TOKENS_SQL}))
GROUP BY book_id, chapter_num
"""


def t15_layout_hash(spark, sf_dir):
    return S.token_hashes(S.tokens(dialogue_chapters(spark, sf_dir)))


QUERIES["t15_layout_hash"] = t15_layout_hash
ORACLE_SQL["t15_layout_hash"] = f"""
SELECT book_id, chapter_num, substr(sha1(string_agg(word, chr(10) ORDER BY token_idx)), 1, 16) AS text_hash, CAST(count(*) AS INTEGER) AS token_count
FROM ({TOKENS_SQL}) GROUP BY book_id, chapter_num
"""


def k1_dialogue_boards(spark, sf_dir):
    return S.boards(dialogue_chapters(spark, sf_dir))


def k3_document_boards(spark, sf_dir):
    return S.boards(document_chapters(spark, sf_dir))


def k5_proposed_layout(spark, sf_dir):
    return S.proposed_layout(dialogue_chapters(spark, sf_dir)).withColumn("breaks", F.array_join(F.col("breaks").cast("array<string>"), ","))


def k4_board_summary(spark, sf_dir):
    """Boards per document: how many, their lines, and the fullest."""
    rows = S.boards(document_chapters(spark, sf_dir))
    return rows.groupBy(*S.KEYS).agg(
        F.count(F.lit(1)).alias("boards"), F.sum("lines_count").alias("lines"), F.max("lines_count").alias("fullest"), F.sum("n_words").alias("words")
    )


def t6_mapped_chapters(spark, sf_dir):
    books = document_chapters(spark, sf_dir).select(F.col("chapter_num").cast("string").alias("book_id"), F.regexp_replace("text", "\n\n", "\n").alias("text"))
    parts = books.select("book_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("chapter_num"), F.length("text").alias("n")).select(
        "book_id", "chapter_num", F.lit("h").alias("header"), F.lit("t").alias("title"),
        F.when(F.col("chapter_num") == 1, 0).otherwise(F.floor(F.col("n") / 3)).cast("int").alias("text_start"),
        F.when(F.col("chapter_num") == 1, F.floor(F.col("n") / 3)).otherwise(0).cast("int").alias("text_end"),
    )
    return S.mapped_chapters(books, parts)


QUERIES |= {f.__name__: f for f in (k1_dialogue_boards, k3_document_boards, k4_board_summary, k5_proposed_layout, t6_mapped_chapters)}
ORACLE_SQL["t6_mapped_chapters"] = """
SELECT CAST(doc_id AS VARCHAR) AS book_id, c AS chapter_num, 'h' AS header, 't' AS title,
       CASE WHEN c = 1 THEN CASE WHEN length(t) // 3 <= 0 THEN t ELSE substr(t, 1, length(t) // 3) END ELSE substr(t, length(t) // 3 + 1) END AS text
FROM (SELECT doc_id, replace(coalesce(text, ''), chr(10) || chr(10), chr(10)) AS t FROM documents), (VALUES (1), (2)) v(c)
"""
ORACLE_SQL["k1_dialogue_boards"] = boards_sql(CHAPTERS_SQL)
ORACLE_SQL["k3_document_boards"] = boards_sql(DOCUMENTS_SQL)
ORACLE_SQL["k4_board_summary"] = f"""
SELECT book_id, chapter_num, count(*) AS boards, CAST(sum(lines_count) AS BIGINT) AS lines, max(lines_count) AS fullest, CAST(sum(n_words) AS BIGINT) AS words FROM ({boards_sql(DOCUMENTS_SQL)}) GROUP BY 1, 2
"""
ORACLE_SQL["k5_proposed_layout"] = f"""
SELECT c.book_id, c.chapter_num, coalesce(breaks, '') AS breaks, CAST(coalesce(n, 0) AS INTEGER) AS token_count FROM ({CHAPTERS_SQL}) c LEFT JOIN (
  SELECT chapter_num, string_agg(CASE WHEN chunk_id < last THEN CAST(run AS VARCHAR) END, ',' ORDER BY chunk_id) AS breaks, max(run) AS n
  FROM (SELECT *, sum(n_words) OVER (PARTITION BY chapter_num ORDER BY chunk_id) AS run, max(chunk_id) OVER (PARTITION BY chapter_num) AS last FROM ({boards_sql(CHAPTERS_SQL)})) GROUP BY 1) b ON b.chapter_num = c.chapter_num
"""
