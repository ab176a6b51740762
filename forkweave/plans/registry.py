"""Queries over the derived event graph, by name, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.derived import SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name; sql continues the derived graph's WITH clause."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = SQL + sql
        return fn

    return add


from . import authority, cases, graphs, ingest, reports, resolutions, states  # noqa: E402, F401
