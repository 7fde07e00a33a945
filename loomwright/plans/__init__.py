"""End-to-end plans and the registry of queries."""

from __future__ import annotations


def queries() -> dict:
    from . import registry, store_queries, text_queries  # noqa: F401

    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    from . import registry

    return registry.ORACLE
