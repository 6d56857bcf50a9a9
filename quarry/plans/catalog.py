"""The registered queries: a name, a function of (spark, sf_dir), and the same question as SQL where SQL can put it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import oracle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of a reader t(table or view name) -> DataFrame."""

    def add(make: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: make(partial(table, spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return make

    return add
