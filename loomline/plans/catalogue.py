"""Queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame under its function's name, with its SQL if there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add
