"""Query of the spelling variants."""

from __future__ import annotations

from tidemark.llm import spelling
from tidemark.llm._shared import documents


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(documents(spark, sf_dir))


# The checksum byte by byte with its table; near words by the words less one letter.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), run AS (
  SELECT id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS times
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents)
  GROUP BY ALL
), byte AS (
  SELECT id, r, times, hex(encode(id || ':' || r)) AS x, length(r) AS len FROM run
), hash AS (
  SELECT r, times, len,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x), 2), lambda i: CAST('0x' || substr(x, CAST(i + 1 AS INT), 2) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM byte, crc
), word AS (
  SELECT w AS word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % len) || substr(r, h % len + 2) ELSE r END AS w, times FROM hash)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(times) >= 3
), less AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)
), pair AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT less.word, less.key FROM less JOIN word ON word.word = less.key
  UNION SELECT less.key, less.word FROM less JOIN word ON word.word = less.key
), near AS (
  SELECT a AS word, CAST(count(*) AS BIGINT) AS n_near, min((-word.n, b)) AS best FROM pair JOIN word ON word.word = b GROUP BY a
), form AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END AS form_n
  FROM word LEFT JOIN near USING (word)
), step(word, here, next) AS (
  SELECT word, word, form FROM form
  UNION ALL SELECT step.word, form.word, form.form FROM step JOIN form ON form.word = step.next
)
SELECT form.word, n, n_near, form, form_n, step.here AS root FROM form JOIN step ON step.word = form.word AND step.next IS NULL
"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLE_SQL = {"op13_spelling_variants": OP13_SQL}
