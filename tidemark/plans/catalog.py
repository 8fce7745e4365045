"""All registered queries and their SQL twins."""

from __future__ import annotations

from tidemark.plans import alignment_queries, chapter_queries, file_queries, segment_queries, signal_queries, state_queries, text_queries, timing_queries, view_queries

_MODULES = [text_queries, segment_queries, signal_queries, timing_queries, view_queries, alignment_queries, chapter_queries, file_queries, state_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = timing_queries.u8_timed_boards
