"""Small helper to register a query beside its oracle."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict = {}

    def query(name: str, sql: str | None = None):
        def keep(f):
            queries[name] = f
            if sql:
                oracles[name] = sql
            return f

        return keep

    return queries, oracles, query
