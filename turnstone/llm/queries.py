"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import align, decontam, exact_dedup, html_extract, lang_id, license_scan, merkle, mixing, ngram_join, sharding, suffix_dedup, toxicity, url_filter

_MODULES = (mixing, html_extract, decontam, license_scan, sharding, lang_id, ngram_join, exact_dedup, url_filter, toxicity, align, suffix_dedup, merkle)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLE.items()}
