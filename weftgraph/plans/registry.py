"""Where query modules register what the driver runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.plans.fixtures import Fixture, with_modules, with_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, view: bool = True, modules: bool = False):
    """Register a function of a Fixture under its name, with the SQL that gives the same rows, over the graph view or
    over the module graphs that are compared."""

    def add(f: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_modules(sql) if modules else with_view(sql) if view else sql
        return f

    return add
