"""Registry of queries and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.plans.views import Env, duck_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(env) -> DataFrame`` under ``name`` with the SQL it has to agree with."""

    def wrap(fn: Callable[[Env], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Env(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = duck_sql(oracle)
        return fn

    return wrap
