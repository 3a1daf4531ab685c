"""Capacity of test equipment against demand, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planforge.functions.columns import clip, default, md5_strict, severity

#: (mode, suffix of its shift columns)
MODES = (("NORMAL", "normal"), ("MAXIMUM", "max"))
RETESTS = ("TYPE1", "TYPE2")
#: What a need is worth where nothing can be produced.
NO_CAPACITY = 9999.0


def retest_factors(kind: Column) -> tuple[Column, Column]:
    """R and X of a retest type: fixed for TYPE1, from first and later retest yields for TYPE2."""
    y1, y2 = default("yield_retest_1", 0.80, True), default("yield_retest_2_plus", 0.90, True)
    quote = default("retest_quote", 0.75, True)
    return F.when(kind == "TYPE2", (1 - y1 + y2) / y2).otherwise(2.0), F.when(kind == "TYPE2", quote).otherwise(0.75)


def with_steps(df: DataFrame) -> DataFrame:
    """The five steps from times to need and gap, each from the columns of the one before.

    Needs handling_time_sec, target_test_time_sec, target_yield, retest_r, retest_x,
    utilization_rate, hours, allowance_pct, productivity_pct, working_days, shifts,
    equip_qty_available and effective_demand_qty. NULLs take defaults, no NaN or infinity arises
    but for utilization_pct without supply.
    """
    hours, days, shifts = default("hours", 8.0, True), default("working_days", 22.0, True), default("shifts", 2.0, True)
    allowance, productivity = F.coalesce("allowance_pct", F.lit(0.1)), default("productivity_pct", 0.95, True)
    y = clip(default("target_yield", 0.95, True), 0.01, 0.99)
    use = clip(default("utilization_rate", 0.85, True), 0.01, 1.0)
    demand, equipment = F.coalesce("effective_demand_qty", F.lit(0.0)), F.coalesce("equip_qty_available", F.lit(0))
    time = F.coalesce("handling_time_sec", F.lit(0.0)) + F.coalesce("target_test_time_sec", F.lit(0.0))
    df = df.withColumn("step1_avg_test_time", time * (1 + (1 - y) * F.col("retest_r") * F.col("retest_x")))
    df = df.withColumn("step2_total_avg_test_time", F.col("step1_avg_test_time") / use)
    per_shift = F.try_divide(hours * 3600, F.col("step2_total_avg_test_time"))
    df = df.withColumns({"step3_productivity_raw": F.coalesce(per_shift, F.lit(0.0)), "step4_monthly_shifts": days * shifts})
    df = df.withColumn("step3_productivity_adjusted", F.col("step3_productivity_raw") * (1 - allowance) * productivity)
    df = df.withColumn("supply_per_equip_unit", F.col("step3_productivity_adjusted") * F.col("step4_monthly_shifts"))
    df = df.withColumns({"capacity_qty": equipment * F.col("supply_per_equip_unit"), "need_fractional": F.when(F.col("supply_per_equip_unit") > 0, demand / F.col("supply_per_equip_unit")).otherwise(NO_CAPACITY)})
    gap = F.col("capacity_qty") - demand
    df = df.withColumns(
        {
            "step5_need": F.col("need_fractional"),
            "need_ceiling": F.ceil("need_fractional"),
            "gap_qty": gap,
            "supply_headroom_qty": F.greatest(gap, F.lit(0.0)),
            "gap_pct": F.when(demand > 0, gap / demand).otherwise(0.0),
            "utilization_pct": F.when(F.col("capacity_qty") > 0, demand / F.col("capacity_qty")).otherwise(float("inf")),
        }
    )
    return df.withColumns(
        {
            "investment_need_units": F.greatest(F.col("need_ceiling") - equipment, F.lit(0)),
            "excess_capacity_units": F.greatest(equipment - F.col("need_ceiling"), F.lit(0)),
            "is_bottleneck": F.col("gap_qty") < 0,
            "is_excess": F.col("gap_pct") > 0.15,
            "bottleneck_severity": severity("gap_pct"),
        }
    )


def capacity_modes(base: DataFrame) -> DataFrame:
    """Each planning row under both shift modes and both retest types, in one pass.

    The four cases are an array exploded in the row, after the columns have been narrowed; there is
    no join and no shuffle.
    """
    cases = F.array(
        *[
            F.struct(F.lit(m).alias("capacity_mode"), F.lit(r).alias("retest_type"), *[F.col(f"{a}_{s}").cast("double").alias(b) for a, b in (("working_days", "working_days"), ("shifts_per_day", "shifts"), ("hours_per_shift", "hours"))])
            for m, s in MODES
            for r in RETESTS
        ]
    )
    kept = [c for c in base.columns if not c.endswith(("_normal", "_max"))]
    out = base.select(*kept, F.explode(cases).alias("case")).select(*kept, "case.*")
    r, x = retest_factors(F.col("retest_type"))
    out = with_steps(out.withColumns({"retest_r": r, "retest_x": x}))
    return out.withColumn("cap_pk", md5_strict("gcm_pk", "capacity_mode", "retest_type"))


def normal_and_maximum(base: DataFrame) -> DataFrame:
    """Each planning row under both retest types in the normal mode, with capacity and gap of the maximum mode beside it: no join."""
    shifts = {m: {b: F.col(f"{a}_{s}").cast("double") for a, b in (("working_days", "working_days"), ("shifts_per_day", "shifts"), ("hours_per_shift", "hours"))} for m, s in MODES}
    out = base.withColumn("retest_type", F.explode(F.array(*map(F.lit, RETESTS))))
    r, x = retest_factors(F.col("retest_type"))
    out = out.withColumns({"retest_r": r, "retest_x": x})
    given = out.columns
    most = with_steps(out.withColumns(shifts["MAXIMUM"])).select(*given, F.col("capacity_qty").alias("max_capacity_qty"), F.col("gap_qty").alias("max_gap_qty"))
    normal = with_steps(most.withColumns(shifts["NORMAL"])).withColumn("capacity_mode", F.lit("NORMAL"))
    return normal.withColumn("cap_pk", md5_strict("gcm_pk", "capacity_mode", "retest_type"))


def with_predicted_yield(base: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Capacity with predicted yields where there are any; predictions are brought to one row per key first."""
    one = predictions.groupBy(*keys).agg(F.avg("predicted_yield").alias("predicted_yield"))
    out = base.join(one, keys, "left").withColumn("target_yield", clip(F.coalesce("predicted_yield", "target_yield"), 0.5, 0.99))
    out = out.withColumns({"retest_r": F.lit(2.0), "retest_x": F.lit(0.75), "working_days": F.col("working_days_normal").cast("double"), "shifts": F.col("shifts_per_day_normal").cast("double"), "hours": F.col("hours_per_shift_normal").cast("double")})
    out = with_steps(out)
    ratio = clip(F.try_divide(F.col("effective_demand_qty"), F.col("capacity_qty")), 0.0, 5.0)
    return out.withColumns({"ml_utilization_ratio": F.coalesce(ratio, F.lit(5.0)), "ml_gap_pct": F.col("gap_pct") * 100, "yield_source": F.when(F.col("predicted_yield").isNull(), "TARGET").otherwise("PREDICTED")})
