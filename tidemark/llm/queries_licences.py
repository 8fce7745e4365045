"""Query of the licence scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import licences
from tidemark.llm._shared import documents


def op10_licence_rules(spark, sf_dir):
    found = licences.scan(documents(spark, sf_dir))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return found.select("doc_id", *(text(c).alias(c) for c in ("sentence_ids", "wrapped_ids", "rules", "licences")))


def _values(rows):
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows)


_CUT = r"regexp_replace({}, '([.!?;:])[ \t\n\r\f]+', '\1' || chr(30), 'g')"
OP10_SQL = rf"""
WITH known(id, sentence) AS (VALUES {_values(licences.SENTENCES.items())}),
rule(nth, rule, licence, ids) AS (VALUES {_values((k, r, l, "," + ",".join(map(str, i)) + ",") for k, (r, l, i) in enumerate(licences.RULES))}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT doc_id, 'lines' AS way, string_split(translate({_CUT.format("text")}, chr(10) || chr(13), chr(30) || chr(30)), chr(30)) AS parts FROM d
  UNION ALL
  SELECT doc_id, 'wrapped', string_split({_CUT.format(r"regexp_replace(regexp_replace(text, '\r?\n[ \t\r\n\f]*\n', chr(30), 'g'), '[\r\n]+', ' ', 'g')")}, chr(30)) FROM d
),
part AS (SELECT doc_id, way, unnest(parts) AS part, generate_subscripts(parts, 1) AS nth FROM cut),
hit AS (
  SELECT doc_id, way, string_agg(CAST(id AS VARCHAR), ',' ORDER BY nth) AS ids
  FROM (SELECT doc_id, way, nth, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS s FROM part) JOIN known ON s = sentence
  GROUP BY doc_id, way
),
seq AS (
  SELECT d.doc_id, coalesce(a.ids, '') AS sentence_ids, coalesce(b.ids, '') AS wrapped_ids
  FROM d LEFT JOIN hit a ON a.doc_id = d.doc_id AND a.way = 'lines' LEFT JOIN hit b ON b.doc_id = d.doc_id AND b.way = 'wrapped'
),
m AS (
  SELECT doc_id, string_agg(rule, ',' ORDER BY nth) AS rules, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
  FROM seq JOIN rule ON contains(',' || sentence_ids || ',', ids) OR contains(',' || wrapped_ids || ',', ids)
  GROUP BY doc_id
)
SELECT seq.doc_id, sentence_ids, wrapped_ids, coalesce(rules, '') AS rules, coalesce(licences, '') AS licences
FROM seq LEFT JOIN m ON m.doc_id = seq.doc_id
"""

QUERIES = {"op10_licence_rules": op10_licence_rules}
ORACLE_SQL = {"op10_licence_rules": OP10_SQL}
