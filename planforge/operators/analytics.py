"""Rollups and comparisons built on the planning base, the capacity table and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planforge.functions.columns import ROLLUP_SCALE, calendar_features, clip, consistent, severity
from planforge.operators.capacity import RETESTS
from planforge.operators.windows import lags, rolling, series

GAP_KEYS = ["site_code", "month_key", "snapshot_id", "capacity_mode", "retest_type", "test_type"]


def daily_rollup(raw: DataFrame, keys: list[str], sums: list[str], means: list[str], dedup: bool = False) -> DataFrame:
    """Sums and means per key and day; with dedup, repeated rows count once."""
    rows = raw.dropDuplicates() if dedup else raw
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])


def flag_consistency(df: DataFrame) -> DataFrame:
    return df.withColumn("qty_consistent", consistent("passed_qty", "failed_qty", "total_qty"))


def demand_vs_capacity(capacity: DataFrame, parity: bool = False) -> DataFrame:
    """Normal rows with the maximum of the same planning row and retest type, and the flexibility between them.

    The planning key holds the parent, so the join is one to one; parity leaves the parent out of it.
    """
    keys = ["gcm_pk", "retest_type"] if not parity else ["site_code", "product_number", "test_type", "equipment_id", "month_key", "snapshot_id", "retest_type"]
    normal, most = capacity.where("capacity_mode = 'NORMAL'"), capacity.where("capacity_mode = 'MAXIMUM'")
    extra = most.select(*keys, F.col("capacity_qty").alias("max_capacity_qty"), F.col("gap_qty").alias("max_gap_qty"))
    return flexible(normal.join(extra, keys, "left"))


def parity_counts(folded: DataFrame) -> DataFrame:
    """site_code, snapshot_id, and of ``demand_vs_capacity`` with parity of the folded base: n, its rows, and matched, those with a maximum.

    A product that c planning rows of a cell and snapshot plan gives c * c rows for each piece of equipment and retest type, and c without
    a match where there is none: the counts need neither the rows nor the join. A product's rows of a cell lie in one folded row.
    """
    units, per = F.coalesce(F.size("equipment"), F.lit(0)), ["site_code", "snapshot_id", "test_type", "month_key", "part", "units", "product_number"]
    rows = folded.select(*per[:5], units.alias("units"), F.explode("plans.product_number").alias("product_number"))
    return parity_of_counts(rows.groupBy(*per).agg(F.count("*").alias("c")))


def parity_of_counts(rows: DataFrame) -> DataFrame:
    """The same from ``c``, how many planning rows of a cell and snapshot plan a product, and ``units``, the equipment of the cell."""
    pairs = F.col("c") * F.col("c") * F.col("units")
    matched = F.when(F.col("product_number").isNotNull(), pairs).otherwise(0)
    n = F.when(matched > 0, pairs).otherwise(F.col("c") * F.greatest("units", F.lit(1)))
    return rows.groupBy("site_code", "snapshot_id").agg((F.sum(n) * len(RETESTS)).alias("n"), (F.sum(matched) * len(RETESTS)).alias("matched"))


def flexible(sides: DataFrame) -> DataFrame:
    """Rows that hold both modes, with the room between them."""
    return sides.withColumn("flexibility_pct", F.try_divide(F.col("max_capacity_qty") - F.col("capacity_qty"), F.col("capacity_qty")))


def bottlenecks(capacity: DataFrame) -> DataFrame:
    """The worst gap per site, month, snapshot, mode, retest and test type, on the severity scale for rollups."""
    out = capacity.groupBy(*GAP_KEYS, "equipment_type").agg(
        F.min("gap_pct").alias("min_gap_pct"),
        F.min("gap_qty").alias("worst_gap_qty"),
        F.sum("investment_need_units").alias("total_investment_need_units"),
        F.countDistinct(F.when(F.col("is_bottleneck"), F.col("product_number"))).alias("affected_products"),
        F.sum(F.when(F.col("is_bottleneck"), F.col("effective_demand_qty")).otherwise(0.0)).alias("affected_demand_qty"),
        F.avg("gap_pct").alias("avg_gap_pct"),
        F.avg(F.when(F.col("capacity_qty") > 0, F.col("utilization_pct"))).alias("avg_utilization_pct"),
    )
    return out.withColumn("bottleneck_severity", severity("min_gap_pct", ROLLUP_SCALE))


def oee(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Availability, performance, quality and their product, from daily telemetry of an eight-hour shift."""
    means = daily.groupBy(*keys).agg(
        F.avg("equipment_downtime_avg_sec").alias("down"), F.avg("actual_throughput_uph").alias("thr"), F.avg("idle_time_avg_sec").alias("idle"), F.avg("yield_avg").alias("y")
    )
    parts = {
        "availability": F.coalesce(1 - F.col("down") / 28800, F.lit(0.85)),
        "performance": F.coalesce(F.try_divide(F.col("thr"), F.col("thr") + F.col("idle") / 60), F.lit(0.85)),
        "quality": F.coalesce(F.col("y"), F.lit(0.85)),
    }
    out = means.select(*keys, *[clip(c, 0.0, 1.0).alias(n) for n, c in parts.items()])
    return out.withColumn("oee", clip(F.col("availability") * F.col("performance") * F.col("quality"), 0.0, 1.0))


def forecast_accuracy(demand: DataFrame, baseline: str, later: str) -> DataFrame:
    """Baseline demand against that of a later snapshot for the same site, product and month."""
    keys = ["site_code", "product_number", "month_key"]
    old = demand.where(F.col("snapshot_id") == baseline).select(*keys, F.col("demand_qty").alias("forecast_qty"))
    new = demand.where(F.col("snapshot_id") == later).select(*keys, F.col("demand_qty").alias("actual_qty"))
    out = new.join(old, keys)
    error = F.col("forecast_qty") - F.col("actual_qty")
    return out.withColumns({"forecast_error": error, "abs_error": F.abs(error), "pct_error": F.try_divide(F.abs(error), F.col("actual_qty")), "bias_pct": F.try_divide(error, F.col("actual_qty"))})


def monthly_actuals(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Telemetry per month; days without a yield are left out."""
    sums = [F.sum(c).alias(c) for c in ("total_qty", "passed_qty", "failed_qty")]
    means = [F.avg(c).alias(f"actual_{c}") for c in ("yield_avg", "test_duration_avg_sec", "handling_time_avg_sec", "idle_time_avg_sec", "equipment_downtime_avg_sec", "actual_throughput_uph")]
    return daily.where(F.col("yield_avg").isNotNull()).groupBy(*keys).agg(*sums, *means)


def actual_vs_target(actuals: DataFrame, plan: DataFrame, cutoff: int, match_month: bool = True) -> DataFrame:
    """Monthly actuals with the distinct planned yield and test time; without match_month, of every month up to the cutoff."""
    keys = ["site_code", "product_number", "test_type"] + ["month_key"] * match_month
    targets = plan.where(F.col("month_key") <= cutoff).select(*keys, "target_yield", "target_test_time_sec").distinct()
    out = actuals.where(F.col("month_key") <= cutoff).join(targets, keys)
    return out.withColumns({"yield_variance": F.col("actual_yield_avg") - F.col("target_yield"), "test_time_variance_sec": F.col("actual_test_duration_avg_sec") - F.col("target_test_time_sec")})


def feature_store(monthly: DataFrame, keys: list[str], cutoff: int) -> DataFrame:
    """Calendar flags, lags and rolling figures per series. All windows share one partitioning and one sort.

    ``monthly`` has one row per series and month, so that the order in a series is total.
    """
    w = series(keys)
    new = {
        **calendar_features("month_key", cutoff),
        **lags("demand_qty", [1, 3, 6, 12], w, "demand"), **rolling("demand_qty", [3, 6], w, "demand"), "demand_roll_std_3": F.stddev_samp("demand_qty").over(w.rowsBetween(-2, 0)),
        **lags("target_yield", [1, 3], w, "yield"), **rolling("target_yield", [3], w, "yield"),
        **lags("target_test_time_sec", [1], w, "test_time"), **rolling("target_test_time_sec", [3], w, "test_time"),
    }
    return monthly.withColumns(new)
