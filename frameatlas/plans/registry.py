"""Queries by name, the inventory entries each covers, and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under its own name."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key], COVERS[key] = fn, covers.split()
        if sql:
            SQL[key] = sql
        return fn

    return add
