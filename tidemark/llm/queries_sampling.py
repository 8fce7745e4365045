"""Queries of the operators that choose and arrange documents."""

from __future__ import annotations

from tidemark.llm import mixing
from tidemark.llm._shared import documents


def op1_source_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM d GROUP BY source
), f AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(3 * source_size) OVER before, 0) AS left_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest
  FROM s WINDOW before AS (ORDER BY source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, left_words * weight / rest > 3 * source_size AS capped FROM f
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
              ELSE (CAST(sum(source_size) OVER () AS DOUBLE) - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ()) * weight
                   / sum(CASE WHEN capped THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target
  FROM c
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS whole FROM t
), l AS (
  SELECT *, greatest(0.0, g.target - g.whole * g.source_size) AS need FROM g
), x AS (
  SELECT d.*, pow(2.0::DOUBLE, round(log2(greatest(size, 1)) * 16) / 16) AS w,
         (CAST('0x' || substr(sha256('{mixing.SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM d
), y AS (
  SELECT source, w, sum(size)::BIGINT AS words FROM x WHERE size > 0 GROUP BY 1, 2
), z AS (
  SELECT y.*, need, (need - coalesce(sum(words) OVER (PARTITION BY y.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
         < sum(w * words) OVER (PARTITION BY y.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * (1 - 1e-12) AS is_open
  FROM y JOIN l ON y.source IS NOT DISTINCT FROM l.source
), p AS (
  SELECT source, max(w) FILTER (is_open) AS most_w FROM z GROUP BY 1
), q AS (
  SELECT z.source, any_value(most_w) AS most_w, (any_value(need) - sum(CASE WHEN w > most_w THEN words ELSE 0 END)) / nullif(sum(CASE WHEN w > most_w THEN 0.0::DOUBLE ELSE w * words END), 0) AS rate
  FROM z JOIN p ON z.source IS NOT DISTINCT FROM p.source GROUP BY 1
), o AS (
  SELECT *, CASE WHEN w > most_w THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END AS odds
  FROM (SELECT x.*, l.source_size, l.target, l.whole, l.need, q.most_w, least(1 - 1e-9, greatest(1e-9, coalesce(rate, 0) * x.w)) AS p
        FROM x JOIN l ON x.source IS NOT DISTINCT FROM l.source LEFT JOIN q ON x.source IS NOT DISTINCT FROM q.source)
), k AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM o
)
SELECT doc_id, source, size, source_size, target,
       CAST(whole + CASE WHEN size > 0 AND need > 0 AND run - size / 2 <= need THEN 1 ELSE 0 END AS INTEGER) AS copies,
       CAST((whole + CASE WHEN size > 0 AND need > 0 AND run - size / 2 <= need THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM k
"""

QUERIES = {"op1_source_mixing": op1_source_mixing}
ORACLE_SQL = {"op1_source_mixing": OP1_SQL}
