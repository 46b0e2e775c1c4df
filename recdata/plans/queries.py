"""All queries of the library and their SQL."""

from __future__ import annotations

from . import queries_eval, queries_more, queries_splits, queries_text

_MODULES = (queries_splits, queries_eval, queries_text, queries_more)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
