"""Queries of the deduplication operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, exact_dedup, simhash
from tidemark.llm._shared import documents


def op9_exact_dedup(spark, sf_dir):
    """In two batches, so that the second one meets an index that holds the first."""
    return exact_dedup.classes(documents(spark, sf_dir), batches=2)


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

def op8_covering_simhash(spark, sf_dir):
    found = simhash.classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept")


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# Cosines in double precision; the smallest reachable id by propagation along links.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), good AS (
  SELECT vec_id, x FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND list_inner_product(x, x) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9
), reach(vec_id, root) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.vec_id WHERE reach.root < link.b
), root AS (
  SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a
)
SELECT root.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, root.vec_id = component_id AS kept
FROM root LEFT JOIN n ON n.vec_id = root.vec_id
"""


QUERIES = {"op3_embedding_dedup": op3_embedding_dedup, "op9_exact_dedup": op9_exact_dedup, "op8_covering_simhash": op8_covering_simhash}
ORACLE_SQL = {"op3_embedding_dedup": OP3_SQL, "op9_exact_dedup": OP9_SQL}
