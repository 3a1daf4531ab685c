"""Queries of sources and sinks, derived columns, validation and reshaping (A to D, J)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from planforge.functions import columns as C
from planforge.operators import quality as V
from planforge.operators import reshape as S
from planforge.plans import adapters as A
from planforge.plans.adapters import CUTOFF, table
from planforge.queries.base import R, query, r, rounded
from planforge.sources import io

# A: sources and sinks


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def a1_table_scan(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def a2_split_scan(spark, sf):
    return io.read_splits(spark, f"{sf}/lineitem.parquet", split_mb=32).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT factory_code, product_number, total_qty FROM daily WHERE month_key = 199803 AND yield_avg IS NOT NULL")
def a3_partition_scan(spark, sf):
    return A.daily(spark, sf).where("month_key = 199803 and yield_avg is not null").select("factory_code", "product_number", "total_qty")


@query("SELECT DISTINCT month_key FROM fact ORDER BY 1")
def a4_partitions(spark, sf):
    return A.fact(spark, sf).select("month_key").distinct().orderBy("month_key")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def a5_overwrite_sink(spark, sf):
    at = io.scratch(spark, "overwrite")
    out = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    io.overwrite(out.limit(0), at)
    return io.overwrite(out, at)


@query("SELECT n_nationkey, n_name, 'A' AS part FROM nation UNION ALL SELECT n_nationkey, n_name, 'B' FROM nation WHERE n_regionkey = 1")
def a6_append_sink(spark, sf):
    nation = table(spark, sf, "nation")
    at = io.scratch(spark, "append")
    io.overwrite(nation.select("n_nationkey", "n_name", F.lit("A").alias("part")), at)
    return io.append(nation.where("n_regionkey = 1").select("n_nationkey", "n_name", F.lit("B").alias("part")), at)


@query(f"SELECT site_code, test_type, {R('sum(total_qty)', 2)} AS qty FROM fact WHERE month_key BETWEEN 199701 AND 199706 GROUP BY 1, 2")
def a7_partitioned_layout(spark, sf):
    rows = A.fact(spark, sf).select("site_code", "test_type", "total_qty", F.floor(F.col("month_key") / 100).cast("int").alias("year"), "month_key")
    laid = io.write_partitioned(rows, io.scratch(spark, "layout"), ["year"], ["site_code", "month_key"])
    got = laid.where("year = 1997 and month_key between 199701 and 199706")
    return got.groupBy("site_code", "test_type").agg(r(F.sum("total_qty"), 2).alias("qty"))


@query("SELECT site_code, count(*) AS n FROM fact GROUP BY 1")
def a8_views(spark, sf):
    io.create_views({"vw_planforge_site_lines": A.fact(spark, sf).groupBy("site_code").agg(F.count("*").alias("n"))})
    return spark.sql("SELECT site_code, n FROM vw_planforge_site_lines")


@query(
    """SELECT 's_suppkey' AS column_name, 'bigint' AS column_type, count(*) AS n_rows, count(*) - count(s_suppkey) AS n_nulls, count(DISTINCT s_suppkey) AS n_distinct, min(s_suppkey::VARCHAR) AS least, max(s_suppkey::VARCHAR) AS largest FROM supplier
    UNION ALL SELECT 's_name', 'string', count(*), count(*) - count(s_name), count(DISTINCT s_name), min(s_name), max(s_name) FROM supplier
    UNION ALL SELECT 's_nationkey', 'int', count(*), count(*) - count(s_nationkey), count(DISTINCT s_nationkey), min(s_nationkey::VARCHAR), max(s_nationkey::VARCHAR) FROM supplier"""
)
def a9_profile(spark, sf):
    return V.profile(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def a10_csv_export(spark, sf):
    out = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return io.csv_round_trip(out, io.scratch(spark, "csv"))


_RAW = """SELECT l_orderkey, l_suppkey, CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE l_partkey END AS product_number, CASE WHEN l_orderkey % 97 = 0 THEN 1 + l_discount ELSE 1 - l_discount END AS yield_avg,
    CASE WHEN l_orderkey % 83 = 0 THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS passed_qty,
    CASE WHEN l_orderkey % 79 = 0 THEN 'x' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS execution_date, l_linenumber FROM lineitem"""
_FAULTS = """SELECT *, list_filter([CASE WHEN product_number IS NULL THEN 'NULL_PRIMARY_KEY:product_number' END,
    CASE WHEN yield_avg NOT BETWEEN 0 AND 1 THEN format('YIELD_OUT_OF_RANGE:yield_avg={:.4f}', yield_avg) END, CASE WHEN passed_qty < 0 THEN 'NEGATIVE_QUANTITY:passed_qty=' || passed_qty END,
    CASE WHEN try_cast(execution_date AS DATE) IS NULL THEN 'INVALID_DATE:execution_date=' || execution_date END,
    CASE WHEN try_cast(execution_date AS DATE) NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN 'DATE_OUT_OF_RANGE:execution_date=' || execution_date END], lambda x: x IS NOT NULL) AS faults FROM raw_lines"""
_RAW_VIEWS = {"raw_lines": _RAW, "checked": _FAULTS}
SPEC = V.TableSpec("telemetry", ("product_number",), ("yield_avg",), ("passed_qty",), "execution_date", "1996-01-01", "2000-12-31")


def _raw(spark, sf):
    k = F.col("l_orderkey")
    qty = F.col("l_quantity").cast("bigint")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", F.when(k % 89 == 0, None).otherwise(F.col("l_partkey")).alias("product_number"), F.when(k % 97 == 0, 1 + F.col("l_discount")).otherwise(1 - F.col("l_discount")).alias("yield_avg"),
        F.when(k % 83 == 0, -qty).otherwise(qty).alias("passed_qty"), F.when(k % 79 == 0, "x").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("execution_date"), "l_linenumber",
    )


@query(
    f"""SELECT table_name, rows_written, rows_valid, rows_invalid, {R('100.0 * rows_invalid / nullif(rows_written, 0)', 4)} AS invalid_pct FROM (
    SELECT 'supplier ' || l_suppkey % 4 AS table_name, count(*) AS rows_written, count(*) FILTER (WHERE len(faults) = 0) AS rows_valid, count(*) FILTER (WHERE len(faults) > 0) AS rows_invalid FROM checked GROUP BY 1
    UNION ALL SELECT 'TOTAL', count(*), count(*) FILTER (WHERE len(faults) = 0), count(*) FILTER (WHERE len(faults) > 0) FROM checked)""",
    _RAW_VIEWS,
)
def a11_ingest_summary(spark, sf):
    return rounded(V.ingest_summary(V.validate(_raw(spark, sf), SPEC), F.concat(F.lit("supplier "), F.col("l_suppkey") % 4)), 4)


@query("SELECT 'nation' AS table_name, count(*) AS n_rows FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def a12_row_counts(spark, sf):
    return io.row_counts({n: table(spark, sf, n) for n in ("nation", "part", "lineitem")})


# B: derived columns and filters


@query("SELECT p_partkey AS product_number, upper(p_brand) AS platform, CAST(p_size AS BIGINT) AS size FROM part")
def b1_project_rename_cast(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product_number"), F.upper("p_brand").alias("platform"), F.col("p_size").cast("bigint").alias("size"))


@query(
    "SELECT n_nationkey, 'nation' AS src_system, 'run-1' AS pipeline_run_id, TIMESTAMP '2024-01-01 00:00:00' AS ingestion_ts, TRUE AS is_valid, '' AS invalid_reason, md5(n_nationkey || '|2024-01-01 00:00:00') AS bronze_id FROM nation"
)
def b3_metadata(spark, sf):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return V.add_metadata(table(spark, sf, "nation").select("n_nationkey"), "nation", "run-1", at, ("n_nationkey",))


@query("SELECT site_code, product_number, month_key, total_qty FROM fact WHERE site_code = 'NATION_3' AND month_key >= 199601 AND month_key <= 199712")
def b5_optional_filters(spark, sf):
    rows = A.fact(spark, sf).select("site_code", "product_number", "month_key", "total_qty")
    from planforge.plans.serving import filtered

    return filtered(rows, equal={"site_code": "nation_3", "product_number": None}, at_least={"month_key": 199601}, at_most={"month_key": 199712})


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_size BETWEEN 5 AND 20")
def b6_in_and_range(spark, sf):
    from planforge.plans.serving import table_filters

    return table_filters(table(spark, sf, "part"), {"p_brand": ["Brand#11", "Brand#22", "Brand#33"], "p_type": ""}, {"p_size": (5, 20)}).select("p_partkey", "p_brand", "p_type")


@query("SELECT order_key, line_number, yield_avg FROM snapshots WHERE yield_avg IS NOT NULL AND total_qty > 10 AND snapshot_id <> 'S1'")
def b8_not_null_and_snapshot(spark, sf):
    return A.snapshots(spark, sf).where("yield_avg is not null and total_qty > 10 and snapshot_id <> 'S1'").select("order_key", "line_number", "yield_avg")


@query("SELECT order_key, line_number, least(30, greatest(10, total_qty)) AS clipped, coalesce(yield_avg, 0.95) AS filled, coalesce(nullif(failed_qty, 0), -1) AS no_zero, round(total_qty / nullif(failed_qty, 0) + 1e-9, 6) AS ratio FROM fact")
def b11_guards(spark, sf):
    return A.fact(spark, sf).select(
        "order_key", "line_number", C.clip("total_qty", 10.0, 30.0).alias("clipped"), C.default("yield_avg", 0.95).alias("filled"), C.default("failed_qty", -1.0, True).alias("no_zero"),
        r(F.try_divide("total_qty", "failed_qty")).alias("ratio"),
    )


@query(f"SELECT order_key, line_number, abs(total_qty - failed_qty + round(failed_qty) - total_qty) <= 1 AS qty_consistent, CASE WHEN month_key <= {CUTOFF} THEN 'ACTUAL' ELSE 'FORECAST' END AS data_type FROM fact")
def b14_flags(spark, sf):
    return A.fact(spark, sf).select("order_key", "line_number", C.consistent(F.col("total_qty") - F.col("failed_qty"), F.round("failed_qty"), "total_qty").alias("qty_consistent"), C.data_type("month_key", CUTOFF).alias("data_type"))


@query(
    "SELECT site_code, month_key, working_days_normal <= working_days_max AND shifts_per_day_normal <= shifts_per_day_max AND hours_per_shift_max <= 8.5 AS is_valid, CASE WHEN hours_per_shift_max <= 8.5 THEN '' ELSE 'SHIFT_ORDER' END AS invalid_reason FROM site_params"
)
def b16_shift_order(spark, sf):
    p = A.site_params(spark, sf)
    ok = (F.col("working_days_normal") <= F.col("working_days_max")) & (F.col("shifts_per_day_normal") <= F.col("shifts_per_day_max")) & (F.col("hours_per_shift_max") <= 8.5)
    return p.select("site_code", "month_key", ok.alias("is_valid"), F.when(ok, "").otherwise("SHIFT_ORDER").alias("invalid_reason"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN d <= .2 THEN 'LOW' WHEN d <= .4 THEN 'MEDIUM' WHEN d <= .7 THEN 'HIGH' ELSE 'CRITICAL' END AS tier,
    CASE WHEN d >= .85 THEN 'WORLD_CLASS' WHEN d >= .65 THEN 'GOOD' WHEN d >= .5 THEN 'AVERAGE' ELSE 'POOR' END AS oee_tier, CASE WHEN g > 0 THEN 'OVER_FORECAST' WHEN g < 0 THEN 'UNDER_FORECAST' ELSE 'ACCURATE' END AS bias,
    CASE WHEN abs(g) > .05 THEN 'SIGNIFICANT' WHEN abs(g) > .02 THEN 'MODERATE' ELSE 'NORMAL' END AS variance_flag,
    CASE WHEN g > .15 THEN 'EXCESS' WHEN g > .05 THEN 'BALANCED' WHEN g >= 0 THEN 'LOW' WHEN g >= -.03 THEN 'MEDIUM' WHEN g >= -.08 THEN 'HIGH' ELSE 'CRITICAL' END AS row_severity,
    CASE WHEN g < -.15 THEN 'CRITICAL' WHEN g < -.08 THEN 'HIGH' WHEN g < -.03 THEN 'MEDIUM' WHEN g < 0 THEN 'LOW' WHEN g < .05 THEN 'BALANCED' ELSE 'EXCESS' END AS rollup_severity
    FROM (SELECT *, l_quantity / 50 AS d, round(l_tax - l_discount + (l_linenumber - 4) / 25, 2) AS g FROM lineitem)"""
)
def b17_tiers(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"d": F.col("l_quantity") / 50, "g": F.round(F.col("l_tax") - F.col("l_discount") + (F.col("l_linenumber") - 4) / 25, 2)})
    return rows.select(
        "l_orderkey", "l_linenumber", C.risk_tier("d").alias("tier"), C.oee_tier("d").alias("oee_tier"), C.bias("g").alias("bias"), C.variance_flag("g").alias("variance_flag"),
        C.severity("g").alias("row_severity"), C.severity("g", C.ROLLUP_SCALE).alias("rollup_severity"),
    )


@query("SELECT cap_pk, CASE bottleneck_severity WHEN 'CRITICAL' THEN 6 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 3 WHEN 'BALANCED' THEN 2 WHEN 'EXCESS' THEN 1 ELSE 0 END AS score FROM cap")
def b18_severity_score(spark, sf):
    from planforge.plans.chains import capacity

    return capacity(spark, sf).select("cap_pk", C.severity_score("bottleneck_severity").alias("score"))


@query(
    f"SELECT DISTINCT month_key, CAST(month_key % 100 AS INTEGER) AS month_of_year, CAST(ceil((month_key % 100) / 3) AS INTEGER) AS quarter, CAST(month_key // 100 AS INTEGER) AS year, CASE WHEN month_key % 100 % 3 = 0 THEN 1 ELSE 0 END AS is_quarter_end, CASE WHEN month_key <= {CUTOFF} THEN 1 ELSE 0 END AS is_actual FROM fact"
)
def b22_calendar(spark, sf):
    months = A.fact(spark, sf).select("month_key").distinct()
    return months.withColumns(C.calendar_features("month_key", CUTOFF))


@query("SELECT DISTINCT factory_code || '|' || test_type || '|' || product_number AS join_key FROM fact")
def b23_join_key(spark, sf):
    return A.fact(spark, sf).select(C.join_key("factory_code", "test_type", "product_number").alias("join_key")).distinct()


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 250000.0::DOUBLE WHEN 'ECONOMY' THEN 120000.0::DOUBLE ELSE 150000.0::DOUBLE END AS unit_cost FROM part")
def b24_cost_lookup(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.lookup("p_type", {"PROMO": 250000.0, "ECONOMY": 120000.0}, 150000.0).alias("unit_cost"))


# C: validation


@query("SELECT l_orderkey, l_linenumber, len(faults) = 0 AS is_valid, array_to_string(faults, '; ') AS invalid_reason FROM checked", _RAW_VIEWS)
def c1_validate(spark, sf):
    return V.validate(_raw(spark, sf), SPEC).select("l_orderkey", "l_linenumber", "is_valid", "invalid_reason")


@query("SELECT code, count(*) AS n FROM (SELECT unnest(list_transform(faults, lambda x: split_part(x, ':', 1))) AS code FROM checked) GROUP BY 1", _RAW_VIEWS)
def c5_fault_counts(spark, sf):
    return _raw(spark, sf).select(F.explode(V.reasons(SPEC)).alias("f")).groupBy(F.substring_index("f", ":", 1).alias("code")).agg(F.count("*").alias("n"))


@query("SELECT product_number, factory_code, order_key, line_number FROM fact QUALIFY row_number() OVER (PARTITION BY product_number, factory_code ORDER BY execution_date DESC, order_key, line_number) = 1")
def c6_dedupe(spark, sf):
    rows = A.fact(spark, sf).select("product_number", "factory_code", "order_key", "line_number", "execution_date")
    return V.dedupe(rows, ["product_number", "factory_code"], [F.col("execution_date").desc(), F.col("order_key"), F.col("line_number")]).drop("execution_date")


@query("SELECT 'MISSING:s_city' AS fault, count(*) AS n_rows FROM supplier UNION ALL SELECT 'TYPE:s_nationkey=int', count(*) FROM supplier")
def c7_schema_check(spark, sf):
    rows = table(spark, sf, "supplier")
    declared = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_nationkey", T.LongType()), T.StructField("s_city", T.StringType())])
    faults = F.array(*[F.lit(f) for f in V.schema_faults(rows, declared)])
    return rows.agg(F.count("*").alias("n_rows")).select(F.explode(faults).alias("fault"), "n_rows")


# D: reshaping

#: Months of the given tables; only the SQL needs them spelt out, the queries look them up.
_ALL = [(y * 100 + m, f"{C.MONTHS[m - 1]}_{y}") for y in range(1995, 2002) for m in range(1, 13) if y * 100 + m <= 200111]
_WIDE = ", ".join(f"sum(total_qty) FILTER (WHERE month_key = {k}) AS {label}" for k, label in _ALL)


def _labelled(spark, sf):
    return A.fact(spark, sf).withColumn("label", C.month_label("month_key"))


def _labels(spark, sf):
    """Labels of all months from the first to the last that the table holds, from one aggregate."""
    ends = table(spark, sf, "lineitem").select(C.month_key("l_shipdate").alias("k")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo is not null")
    months = ends.select(F.explode(C.month_range("lo", "hi")).alias("k"))
    return [r["label"] for r in months.orderBy("k").select(C.month_label("k").alias("label")).collect()]


def _wide(spark, sf):
    return S.pivot_months(_labelled(spark, sf), ["site_code", "product_family"], "total_qty", _labels(spark, sf))


@query(f"SELECT site_code, product_family, {_WIDE} FROM fact GROUP BY 1, 2")
def d1_pivot_months(spark, sf):
    return _wide(spark, sf)


@query("SELECT site_code, product_family, month_key, sum(total_qty) AS demand_qty FROM fact GROUP BY 1, 2, 3")
def d2_unpivot_months(spark, sf):
    return S.unpivot_months(_wide(spark, sf), ["site_code", "product_family"], "demand_qty")


@query(
    f"""SELECT g.site_code, g.product_family, m.month_key, f.demand_qty FROM (SELECT DISTINCT site_code, product_family FROM fact) g
    CROSS JOIN (SELECT CAST(unnest({[k for k, _ in _ALL]}) AS INTEGER) AS month_key) m LEFT JOIN (SELECT site_code, product_family, month_key, sum(total_qty) AS demand_qty FROM fact GROUP BY 1, 2, 3) f USING (site_code, product_family, month_key)"""
)
def d3_unpivot_keep_nulls(spark, sf):
    return S.unpivot_months(_wide(spark, sf), ["site_code", "product_family"], "demand_qty", drop_nulls=False)


#: The eleven figures of a site and month: name, aggregate and column.
_METRICS = [
    ("qty", "sum", "total_qty"), ("failed", "sum", "failed_qty"), ("most", "max", "total_qty"), ("least", "min", "total_qty"), ("use", "avg", "utilization_rate"), ("yield", "avg", "yield_avg"),
    ("handling", "avg", "handling_time_sec"), ("test", "avg", "test_time_sec"), ("longest", "max", "test_time_sec"), ("units", "max", "equip_qty"), ("runs", "count", "total_qty"),
]


@query("SELECT site_code, CAST(month_key AS INTEGER) AS month_key, " + ", ".join(R(f"CAST({f}({c}) AS DOUBLE)", 4) + f' AS "{n}"' for n, f, c in _METRICS) + " FROM fact GROUP BY 1, 2")
def d4_unpivot_metrics(spark, sf):
    wide = _labelled(spark, sf).groupBy("site_code").pivot("label", _labels(spark, sf)).agg(*[F.expr(f"{f}({c})").alias(n) for n, f, c in _METRICS])
    return rounded(S.unpivot_metrics(wide, ["site_code"]), 4).where("qty is not null")


@query("SELECT product_number, CAST(child_seq AS INTEGER) AS child_seq, child_product, child_quantity FROM hierarchy")
def d5_explode_children(spark, sf):
    return A.hierarchy(spark, sf)


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("SELECT month_key, " + ", ".join(f"sum(total_qty) FILTER (WHERE region = '{x}') AS \"{x}\"" for x in _REGIONS) + " FROM fact GROUP BY 1")
def d6_spread(spark, sf):
    regions = [r["r_name"] for r in table(spark, sf, "region").select("r_name").orderBy("r_name").collect()]  # a handful, as columns
    return S.spread(A.fact(spark, sf), "month_key", "region", regions, "total_qty")


# J: scalar functions


@query(
    "SELECT p_partkey, md5(p_partkey || '|' || p_brand) AS strict_key, md5(CASE WHEN p_size > 25 THEN p_brand END || '|' || p_type) AS strict_null, md5(coalesce(CASE WHEN p_size > 25 THEN p_brand END, 'NULL') || '|' || p_type) AS null_key FROM part"
)
def j1_keys(spark, sf):
    some = F.when(F.col("p_size") > 25, F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", C.md5_strict("p_partkey", "p_brand").alias("strict_key"), C.md5_strict(some, "p_type").alias("strict_null"), C.md5_key(some, "p_type").alias("null_key"))


@query(
    "SELECT DISTINCT k AS month_key, make_date(k // 100, k % 100, 1) AS month_start, lower(strftime(make_date(k // 100, k % 100, 1), '%b_%Y')) AS label, CAST(k // 100 * 12 + k % 100 AS INTEGER) AS month_number, CAST(strftime(make_date(k // 100, k % 100, 1) + INTERVAL 5 MONTH, '%Y%m') AS INTEGER) AS plus_5, k AS back FROM (SELECT month_key AS k FROM fact)"
)
def j9_months(spark, sf):
    k = A.fact(spark, sf).select("month_key").distinct()
    return k.select("month_key", C.month_start("month_key").alias("month_start"), C.month_label("month_key").alias("label"), C.month_number("month_key").alias("month_number"), C.add_months("month_key", 5).alias("plus_5"), C.month_of_label(C.month_label("month_key")).alias("back"))


@query("SELECT n_nationkey, unnest(list_transform(range(0, CAST(n_regionkey AS BIGINT) + 3), lambda i: CAST(strftime(DATE '1998-11-01' + to_months(CAST(i AS INTEGER)), '%Y%m') AS INTEGER))) AS month_key FROM nation")
def j11_month_range(spark, sf):
    last = C.add_months(F.lit(199811), F.col("n_regionkey") + 2)
    return table(spark, sf, "nation").select("n_nationkey", F.explode(C.month_range(F.lit(199811), last)).alias("month_key"))


@query(
    "SELECT p_partkey, try_cast(CASE WHEN p_size % 2 = 0 THEN '1998-0' || (1 + p_size % 9) || '-11T00' ELSE p_name END[1:10] AS DATE) AS day, regexp_matches(p_brand, '^Brand#[12]') AS is_12, regexp_extract(p_brand, '#(\\d+)', 1) AS brand_no, format('{:.4f}', p_retailprice) AS price, CAST(ceil(p_retailprice / 7) AS BIGINT) AS up FROM part"
)
def j15_text(spark, sf):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("1998-0"), (1 + F.col("p_size") % 9).cast("string"), F.lit("-11T00"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", F.substring(text, 1, 10).try_cast("date").alias("day"), F.col("p_brand").rlike("^Brand#[12]").alias("is_12"), F.regexp_extract("p_brand", r"#(\d+)", 1).alias("brand_no"),
        F.format_string("%.4f", "p_retailprice").alias("price"), F.ceil(F.col("p_retailprice") / 7).alias("up"),
    )
