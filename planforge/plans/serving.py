"""Parameterised reads: filters that may be left out, caps, pages and sorted tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(df: DataFrame, equal: Mapping | None = None, at_least: Mapping | None = None, at_most: Mapping | None = None) -> DataFrame:
    """Conjunction of the given conditions; a None value is no condition; text codes are upper-cased."""
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.where(F.col(c) == (v.upper() if isinstance(v, str) else v))
    for c, v in (at_least or {}).items():
        df = df.where(F.col(c) >= v) if v is not None else df
    for c, v in (at_most or {}).items():
        df = df.where(F.col(c) <= v) if v is not None else df
    return df


def table_filters(df: DataFrame, values: Mapping, ranges: Mapping | None = None) -> DataFrame:
    """Equality or IN per column, blanks ignored, and inclusive ranges."""
    for c, v in values.items():
        if v not in (None, "", []):
            df = df.where(F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v)
    for c, (lo, hi) in (ranges or {}).items():
        df = df.where(F.col(c) >= lo) if lo is not None else df
        df = df.where(F.col(c) <= hi) if hi is not None else df
    return df


def capped(df: DataFrame, order: list[Column], limit: int, cap: int) -> DataFrame:
    """The first rows in a total order; a limit is never above its cap. Spark takes them per partition first."""
    return df.orderBy(*order).limit(max(0, min(limit, cap)))


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 500) -> DataFrame:
    """A page of a totally ordered table, with the number of rows and pages in all."""
    size = max(1, min(size, most))
    total = df.agg(F.count("*").alias("total_rows")).withColumn("total_pages", F.ceil(F.col("total_rows") / size))
    rows = df.orderBy(*order).limit(number * size).offset((number - 1) * size)
    return rows.join(F.broadcast(total), F.col("total_rows") >= 0)  # one row


def distinct_values(df: DataFrame, c: str, limit: int, keep_nulls: bool = False) -> DataFrame:
    out = df.select(c).distinct()
    return (out if keep_nulls else out.where(F.col(c).isNotNull())).orderBy(F.col(c).asc_nulls_first()).limit(min(limit, 200))
