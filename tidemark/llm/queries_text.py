"""Queries of the operators that score and label texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import langid, lm_scoring
from tidemark.llm._shared import documents


def op6_language_spans(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit(docs.filter(langid.in_training())))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op4_context_tree_scores(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return lm_scoring.score(docs, lm_scoring.LanguageModel(docs.filter(~lm_scoring.held_out())))


QUERIES = {"op4_context_tree_scores": op4_context_tree_scores, "op6_language_spans": op6_language_spans}
ORACLE_SQL: dict[str, str] = {}
