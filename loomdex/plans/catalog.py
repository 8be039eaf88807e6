"""All queries of the library outside `llm`, and their SQL."""

from __future__ import annotations

from loomdex.plans import incremental, retrieval, scans, state

MODULES = (incremental, scans, retrieval, state)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
