"""All queries of the library, by name, with their SQL."""

from __future__ import annotations

from loomwell.plans import evaluation, graphs, knowledge, lookups, pages, retrieval, texts

MODULES = (retrieval, texts, knowledge, graphs, pages, lookups, evaluation)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
