"""Registered queries and the SQL their results must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalog.ctes import with_ctes
from barloom.functions.scalars import scaled_round

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


def six(column: str | Column) -> Column:
    """Six digits: sums of doubles depend on their order beyond that."""
    value = F.col(column) if isinstance(column, str) else column
    return scaled_round(value, 6)


def sixes(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: six(name) for name in names})


def fours(df: DataFrame, *names: str) -> DataFrame:
    """Four digits, for prices in the thousands."""
    return df.withColumns({name: scaled_round(F.col(name), 4) for name in names})
