"""Queries and their SQL by name; importing the query modules fills them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with equivalent DuckDB SQL if there is any."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


from quillon.queries import evaluation, graph, places, recommendation, search, stores, vectors  # noqa: E402, F401
