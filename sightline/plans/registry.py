"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import ADAPTERS, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query. In its SQL, names of adapters may be used as tables."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            used = [a for a in ADAPTERS if f"@{a}" in sql]
            body = sql
            for a in sorted(used, key=len, reverse=True):
                body = body.replace(f"@{a}", f"fx_{a}")
            views = ", ".join(f"fx_{a} AS ({duck(a)})" for a in used)
            rest = body.strip()
            if rest.startswith("WITH RECURSIVE ") and used:
                rest = f"WITH RECURSIVE {views}, {rest[15:]}"
            elif rest.upper().startswith("WITH ") and used:
                rest = f"WITH {views}, {rest[5:]}"
            elif used:
                rest = f"WITH {views} {rest}"
            ORACLE_SQL[name] = rest
        return fn

    return keep
