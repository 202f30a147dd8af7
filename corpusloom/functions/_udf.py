"""Pandas UDFs that are made when they are first used, as result types need a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(ddl: str) -> Callable:
    """Like pandas_udf(ddl), but without a session at import."""

    def wrap(f: Callable) -> Callable[..., Column]:
        made: list = []

        @functools.wraps(f)
        def call(*columns: Column) -> Column:
            if not made:
                made.append(F.pandas_udf(f, ddl))
            return made[0](*columns)

        return call

    return wrap
