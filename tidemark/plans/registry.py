"""The registered queries of the library and their SQL."""

from __future__ import annotations

from tidemark.plans import q_engines, q_features, q_sources, q_validation

_MODULES = (q_sources, q_features, q_engines, q_validation)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict[str, str] = {name: s for m in _MODULES for name, s in m.SQL.items()}
