"""How a query is registered: a Spark callable and, where SQL can express it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import ensure_shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ensure_shared_folder(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def r(column: str | Column, places: int = 4, name: str | None = None) -> Column:
    """Rounded for comparison; adding zero turns a negative zero into zero."""
    value = F.col(column) if isinstance(column, str) else column
    return (F.round(value, places) + F.lit(0.0)).alias(name or column)


def sr(expression: str, name: str, places: int = 4) -> str:
    return f"round({expression}, {places}) + 0e0 AS {name}"
