"""Query of the chat operator."""

from __future__ import annotations

from tidemark.llm import tool_calls


def op5_tool_call_links(spark, sf_dir):
    calls, results = tool_calls.from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return tool_calls.link(calls, results, tool_calls.reply_schema(spark))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f]+'), lambda w: w <> '')) AS n_words,
         row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS nth
  FROM conversations
), c AS (SELECT * FROM t WHERE role = 'user'),
r AS (SELECT conv_id, turn, text FROM t WHERE role = 'assistant'),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, 'c' || coalesce(c.conv_id, r.conv_id) || '-' || coalesce(c.turn, r.turn - 1) AS call_id,
         coalesce(c.turn, r.turn) AS position, CASE WHEN c.turn IS NOT NULL THEN c.nth END AS level,
         CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'pending' ELSE 'linked' END AS status,
         c.turn IS NOT NULL AS called, c.text AS prompt, c.turn AS turn, c.n_words AS n_words, r.text AS result
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn - 1
), e AS (
  SELECT *, list_filter([
    CASE WHEN n_words < 1 OR n_words > 60 THEN 'out of range n_words' END,
    CASE WHEN prompt IS NULL THEN 'not string prompt' WHEN length(prompt) < 1 OR length(prompt) > 100000 THEN 'out of range prompt' END,
    CASE WHEN turn < 0 THEN 'out of range turn' END], lambda x: x IS NOT NULL) AS wrong
  FROM j
)
SELECT conv_id, call_id, position, level, status,
       CASE WHEN called THEN len(wrong) = 0 END AS valid,
       CASE WHEN called THEN array_to_string(wrong, '; ') END AS errors,
       '{"arguments":' || CASE WHEN called THEN '{"n_words":' || n_words || ',"prompt":' || coalesce(CAST(to_json(prompt) AS VARCHAR), 'null') || ',"turn":' || turn || '}' ELSE 'null' END
       || ',"call_id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":' || CASE WHEN called THEN '"reply"' ELSE 'null' END
       || ',"result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS json
FROM e
"""

QUERIES = {"op5_tool_call_links": op5_tool_call_links}
ORACLE_SQL = {"op5_tool_call_links": OP5_SQL}
