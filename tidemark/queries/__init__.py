"""Every operator as a named query over the given tables."""

from __future__ import annotations


def all_queries():
    _load()
    from tidemark.queries.registry import QUERIES

    return dict(QUERIES)


def all_sql():
    _load()
    from tidemark.queries.registry import SQL

    return dict(SQL)


def _load() -> None:
    from tidemark.queries import calls, graphs, programs, raw, rows, variants  # noqa: F401
