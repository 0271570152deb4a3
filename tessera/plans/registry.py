"""Queries and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans import model

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_model: bool = True):
    """Register a query (spark, sf_dir); ``sql`` may use the model's tables by name."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {model.SQL.strip()}\n{sql}" if with_model else sql
        return f

    return put


def load() -> None:
    from tessera.plans import graph_queries, pack_queries, scan_queries, search_queries, store_queries  # noqa: F401
