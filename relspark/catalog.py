"""Name -> (query, oracle SQL) for the measurement operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_entries: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in _entries:
            raise ValueError(f"two queries are named {name}")
        _entries[name] = (query, sql)
        return query

    return add


def _load() -> None:
    from . import plans

    plans.load()


def queries() -> dict[str, Query]:
    _load()
    return {k: q for k, (q, _) in _entries.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _entries.items() if s}
