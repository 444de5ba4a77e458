"""Where query modules put their queries and DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers the function under its name, with the statement that says the same."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(column: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, as all doubles in results are."""
    return F.round(column, 6).alias(name or column)
