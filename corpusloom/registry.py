"""Named queries over the driver's tables, each with the SQL it must equal where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = functools.wraps(f)(lambda spark, sf_dir: f(ship(spark), sf_dir))
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from corpusloom.plans import catalog  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
