"""Jobs over whole tables, registered as queries, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pages", "text", "classify", "store", "overlap", "select", "validate", "retrieve", "calendar", "facets", "limits", "logs", "audit", "scans", "chains")


def registered() -> tuple[dict, dict]:
    """All queries and their SQL, the flagship first."""
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
