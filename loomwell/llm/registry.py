"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from loomwell.llm import chat_format, decontaminate, fill_in_middle, filter_audit, html_extract, language_id, line_dedup, near_dedup, one_bit_search, packing, secret_scan, toxicity, webp_media

MODULES = (webp_media, packing, decontaminate, chat_format, line_dedup, language_id, toxicity, secret_scan, near_dedup, html_extract, filter_audit, fill_in_middle, one_bit_search)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
