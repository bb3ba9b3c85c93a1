"""Query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its oracle SQL if it has one."""

    def add(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def r6(c) -> Column:
    """Round to six places; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Every double column rounded to six places."""
    return df.select(
        *[r6(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )


def r(expression: str, alias: str) -> str:
    """The same rounding as oracle text."""
    return f"round({expression}, 6) + 0e0 as {alias}"
