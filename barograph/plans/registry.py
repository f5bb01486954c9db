"""Named queries and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from barograph.sources.fixtures import SQL_VIEWS, Views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(views) under `name`; `sql` is a SELECT, or `, more AS (...) SELECT`, over the same views."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = SQL_VIEWS + sql
        return f

    return add
