"""Registry of the grid queries and their SQL twins.  Each query is registered with @query(sql): name = function name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in ("local", "risk", "focal", "layers", "files", "relational", "quality", "streams", "polygons", "served"):
        importlib.import_module(f"terracell.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
