"""Registered queries and the SQL that gives the same result on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.sources.readers import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where there is one."""
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def day(column: str | Column) -> Column:
    """Date text, the same in every engine."""
    return F.date_format(column, "yyyy-MM-dd")


def moment(column: str | Column) -> Column:
    """Timestamp text with milliseconds, the same in every engine."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS")


def double(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("double")
