"""All queries of the library but those of llm, and their SQL."""

from __future__ import annotations

from . import audits, cameras, captures, clouds, files, records, scenes, series

MODULES = [clouds, series, audits, scenes, records, files, cameras, captures]


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
