"""How a plan module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.sources import derived


class Plans:
    """Queries by name, and SQL for DuckDB over {names} of given and derived tables."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        """Registers a function of t, where t(name) is a table."""

        def add(f: Callable) -> Callable:
            self.queries[name] = lambda spark, sf_dir: f(lambda table: derived.table(spark, sf_dir, table))
            if sql:
                self.oracles[name] = derived.duck(sql)
            return f

        return add
