"""Query registry: each query is registered with its identifiers and, where SQL can say it, an equal SQL text."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            SQL[name] = sql
        return fn

    return add
