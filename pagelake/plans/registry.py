"""Query registry: one named DataFrame builder per operator, plus its portable
SQL twin for the DuckDB oracle (absent for non-SQL operators)."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.views import VIEW_SQL

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def with_views(sql: str, views=()) -> str:
    if not views:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in views)
    s = sql.lstrip()
    if s[:5].upper() == "WITH ":
        return f"WITH {ctes}, {s[5:]}"
    return f"WITH {ctes} {s}"


def register(key: str, sql: str | None = None, views=()):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE_SQL[key] = with_views(sql, views)
        return fn
    return deco
