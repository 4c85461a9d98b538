"""The registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, session: bool = False):
    """Register a function of a table reader under its own name, with the SQL that gives the same rows.

    ``session``: the function takes the session and the folder of the tables too.
    """

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return f(read, spark, sf_dir) if session else f(read)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
