"""Registered queries over the driver's tables, each with an independent SQL statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.transforms import at_edge

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Query name -> callable, and query name -> SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(build: Query) -> Query:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return at_edge(build(spark, folder))

            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql.strip()
            return build

        return keep


def registry() -> Registry:
    from ledgerloom.catalog import files, operators, products, quality, reports, runs, state

    reg = Registry()
    for module in (reports, operators, quality, state, files, products, runs):
        module.register(reg)
    return reg
