"""Wide monthly matrices to rows and back."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planforge.functions.columns import month_of_label

MONTH = re.compile(r"[a-z]{3}_\d{4}")
METRIC = re.compile(r"([a-z]{3}_\d{4})_(\w+)")


def month_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if MONTH.fullmatch(c)]


def unpivot_months(df: DataFrame, ids: list[str], value: str, drop_nulls: bool = True) -> DataFrame:
    """ids, month_key, value: one row per month column; integers and doubles meet as doubles."""
    months = month_columns(df)
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in months])
    long = wide.unpivot(ids, months, "_label", value).withColumn("month_key", month_of_label("_label"))
    long = long.select(*ids, "month_key", value)
    return long.where(F.col(value).isNotNull()) if drop_nulls else long


def unpivot_metrics(df: DataFrame, ids: list[str]) -> DataFrame:
    """ids, month_key and one column per metric, from columns ``mon_YYYY_metric``."""
    parts = {c: m for c in df.columns if (m := METRIC.fullmatch(c))}
    metrics = sorted({m[2] for m in parts.values()})
    months = sorted({m[1] for m in parts.values()}, key=lambda x: (x[4:], x))
    rows = [
        F.struct(F.lit(mon).alias("label"), *[(F.col(f"{mon}_{k}") if f"{mon}_{k}" in parts else F.lit(None)).cast("double").alias(k) for k in metrics])
        for mon in months
    ]  # all metrics of a month are one element, so nothing has to be grouped again
    long = df.select(*ids, F.explode(F.array(*rows)).alias("r"))
    return long.select(*ids, month_of_label("r.label").alias("month_key"), *[F.col(f"r.{k}").alias(k) for k in metrics])


def pivot_months(df: DataFrame, ids: list[str], value: str, labels: list[str]) -> DataFrame:
    """The wide matrix of a long one; labels are listed, so that no job has to find them."""
    return df.groupBy(*ids).pivot("label", labels).agg(F.sum(value))


def explode_children(df: DataFrame, parent: str, most: int = 3) -> DataFrame:
    """parent, child_seq, child_product, child_quantity from numbered column pairs; empty places are left out."""
    rows = [F.struct(F.lit(i).alias("child_seq"), F.col(f"child_product_{i}").alias("child_product"), F.col(f"quantity_child_{i}").cast("double").alias("child_quantity")) for i in range(1, most + 1)]
    return df.select(parent, F.explode(F.array(*rows)).alias("c")).select(parent, "c.*").where("child_product is not null")


def spread(df: DataFrame, x: str, group: str, groups: list[str], value: str) -> DataFrame:
    """One row per x and one column per listed value of group."""
    return df.groupBy(x).pivot(group, groups).agg(F.sum(value))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
