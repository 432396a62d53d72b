"""Every query of the engine's own operators, and their SQL twins."""

from __future__ import annotations

from . import code_queries, maintenance_queries, review_queries, text_queries

_MODULES = (code_queries, text_queries, review_queries, maintenance_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.query.queries.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.query.oracles.items()}
