"""How queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.plans.adapters import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: dict[str, str] | None = None):
    """Registers a function of (spark, sf_dir) under its own name, with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, views)
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded late and off the half-way points, as ``R`` does in SQL, so that sums of doubles compare."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)


def R(expr: str, digits: int = 6) -> str:
    return f"round({expr} + 1e-9, {digits})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded."""
    return df.select(*[r(f"`{c}`" if "." in c else c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
