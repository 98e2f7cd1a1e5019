"""All queries of the core library by name."""

from __future__ import annotations

from scholium.plans import corpus, data_quality, knowledge, pipeline, retrieval

_MODULES = [retrieval, corpus, knowledge, pipeline, data_quality]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
