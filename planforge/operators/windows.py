"""Window operators; every one is per series, none runs over a whole table in one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def series(keys: list[str], order: str = "month_key") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order)


def forward_fill(df: DataFrame, c: str, w: WindowSpec, flag: str = "is_forward_filled") -> DataFrame:
    filled = F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumns({c: filled, flag: F.col(c).isNull() & filled.isNotNull()})


def lags(c: str, steps: list[int], w: WindowSpec, prefix: str | None = None) -> dict[str, Column]:
    return {f"{prefix or c}_lag_{n}": F.lag(c, n).over(w) for n in steps}


def rolling(c: str, sizes: list[int], w: WindowSpec, prefix: str | None = None, std: bool = False, std_fill: float | None = None) -> dict[str, Column]:
    """Means of the last n rows, and sample deviations, which are NULL (or std_fill) for one row."""
    out = {}
    for n in sizes:
        frame = w.rowsBetween(-(n - 1), 0)
        out[f"{prefix or c}_roll_avg_{n}"] = F.avg(c).over(frame)
        if std:
            s = F.stddev_samp(c).over(frame)
            out[f"{prefix or c}_roll_std_{n}"] = s if std_fill is None else F.coalesce(s, F.lit(std_fill))
    return out


def trend(c: str, steps: int, w: WindowSpec) -> Column:
    return F.coalesce(F.col(c) - F.lag(c, steps).over(w), F.lit(0.0))


def from_group_mean(c: str, keys: list[str]) -> Column:
    return F.col(c) - F.avg(c).over(W.partitionBy(*keys))


def below_within(c: str, threshold: float, ahead: int, w: WindowSpec) -> Column:
    """1 if c falls below threshold in any of the next rows."""
    return F.when(F.min(c).over(w.rowsBetween(1, ahead)) < threshold, 1).otherwise(0)


def hold_out_last(df: DataFrame, n: int, keys: list[str], order: str = "month_key") -> DataFrame:
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))
    return df.withColumn("is_test", rn <= n)


def top_n(df: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def percent_rank_of(df: DataFrame, c: str, out: str, buckets: int = 64) -> DataFrame:
    """Average-tie percentile rank of c over all rows, without a window over all rows.

    Values are counted; the counts are ranged into ``buckets`` by approximate quantiles; running
    sums are taken inside buckets and shifted by the sums of the buckets before, one row each.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
    edges = F.array_distinct(F.percentile_approx(c, [i / buckets for i in range(1, buckets)], 10000))
    cuts = df.agg(edges.alias("_edges"))
    placed = counts.join(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col("_v"))))
    inside = F.sum("_n").over(W.partitionBy("_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1))
    sums = placed.groupBy("_b").agg(F.sum("_n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_sum").over(W.partitionBy(F.lit(0)))
    shift = sums.select(F.col("_b").alias("_bb"), before.alias("_before"), total.alias("_total"))  # a row per bucket
    ranks = placed.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(shift), F.col("_b") == F.col("_bb"))
    ranks = ranks.select("_v", ((F.col("_before") + F.col("_in") + (F.col("_n") + 1) / 2) / F.col("_total")).alias(out))
    return df.join(ranks, F.col(c) == F.col("_v"), "left").drop("_v")
