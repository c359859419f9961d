"""Names, Spark builders and equivalent SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadentia.session import tune

BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(spark, folder)`` under ``name``, with SQL where SQL can say it."""

    def register(build):
        if name in BUILDERS:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(tune(spark), folder)

        BUILDERS[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return build

    return register
