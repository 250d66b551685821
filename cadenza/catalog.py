"""All queries by name, with their SQL twins."""

from __future__ import annotations

from .plans import io_queries, session_queries, tempo_queries, waveform_queries

MODULES = (waveform_queries, tempo_queries, io_queries, session_queries)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
