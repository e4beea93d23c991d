"""Registered queries: each operator over the whole driver tables, with the SQL
that states the same result independently where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Collects ``(name, query, sql)``."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn

        return register


def load() -> Catalog:
    from emberline.catalog import config, detection, following, grouping, hosts, streams, texts, times

    whole = Catalog()
    for module in (detection, times, grouping, texts, hosts, config, streams, following):
        whole.queries.update(module.CATALOG.queries)
        whole.sql.update(module.CATALOG.sql)
    return whole
