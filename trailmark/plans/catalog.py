"""The list of runnable queries: name, Spark form, and the same in DuckDB SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        key = name or run.__name__
        RUNS[key] = run
        if sql is not None:
            SQL[key] = sql
        return run

    return register
