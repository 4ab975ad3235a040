"""Registry of the library's queries and of their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable]:
    from siftstone import plans  # noqa: F401  the modules register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from siftstone import plans  # noqa: F401

    return dict(_SQL)
