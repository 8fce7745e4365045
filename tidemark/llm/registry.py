"""All queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import queries_chat, queries_dedup, queries_leaks, queries_licences, queries_sampling, queries_text, queries_tokens, queries_words

_MODULES = [queries_chat, queries_dedup, queries_leaks, queries_licences, queries_sampling, queries_text, queries_tokens, queries_words]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
