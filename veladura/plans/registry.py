"""All registered queries by name."""

from __future__ import annotations

from veladura.plans import doc_queries, gen_queries, pii_queries, table_queries

MODULES = [gen_queries, table_queries, doc_queries, pii_queries]


def queries() -> dict:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
