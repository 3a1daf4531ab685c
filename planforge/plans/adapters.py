"""The given star schema read as planning and telemetry tables; SQL_VIEWS says the same for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.functions.columns import month_key
from planforge.operators.reshape import explode_children

CUTOFF = 200012
TEST_TYPES = ("AF", "AO", "NF", "NO", "RF", "RO")
SERIES = ["site_code", "product_family", "test_type"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 nations as sites: broadcast wherever they are joined."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
    return out.select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("site_code"), F.col("r_name").alias("region"), F.col("r_regionkey").cast("long").alias("region_no"))


def fact(spark: SparkSession, sf_dir: str, share: tuple[int, int] | None = None) -> DataFrame:
    """One row per order line as a test run; with ``share`` (i, n) the i-th of n parts of the orders."""
    line, part, supplier = (table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    line = line.where(_in_share("l_orderkey", share))
    out = line.join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    out = out.join(F.broadcast(sites(spark, sf_dir)), F.col("s_nationkey") == F.col("nation_key"))
    return out.select(
        "site_code", "region", "region_no", F.col("l_suppkey").alias("factory_code"), F.col("l_partkey").alias("product_number"),
        F.col("p_type").alias("product_family"), F.col("p_brand").alias("platform"), F.when(F.col("p_size") <= 5, "NPI").otherwise("OLD").alias("product_status"),
        F.concat("l_returnflag", "l_linestatus").alias("test_type"), month_key("l_shipdate").alias("month_key"), F.to_date("l_shipdate").alias("execution_date"),
        F.col("l_quantity").alias("total_qty"), F.round(F.col("l_quantity") * F.col("l_discount"), 4).alias("failed_qty"),
        F.when(F.col("l_orderkey") % 97 == 0, None).otherwise(F.round(1 - F.col("l_discount"), 2)).alias("yield_avg"),
        F.round(1 - F.col("l_tax"), 2).alias("utilization_rate"), (10.0 + F.col("p_size")).alias("handling_time_sec"), (5.0 * F.col("l_quantity")).alias("test_time_sec"),
        (1 + F.col("l_suppkey") % 4).alias("equip_qty"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"),
    )


def _in_share(key: str, share: tuple[int, int] | None) -> Column:
    return F.lit(True) if share is None else F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(share[1])) == share[0]


def lines(spark: SparkSession, sf_dir: str, share: tuple[int, int] | None = None) -> DataFrame:
    """The fact with the month of its order, NULL without one; with ``share`` (i, n) of the i-th of n parts of the orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), month_key("o_orderdate").alias("order_month"))
    return fact(spark, sf_dir, share).join(orders.where(_in_share("order_key", share)), "order_key", "left")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_of(lines(spark, sf_dir))


def snapshots_of(lines: DataFrame) -> DataFrame:
    """The lines twice: planned by the month of order (S1) and of shipment (S2)."""
    both = F.array(F.struct(F.lit("S1").alias("snapshot_id"), F.col("order_month").alias("month")), F.struct(F.lit("S2").alias("snapshot_id"), F.col("month_key").alias("month")))
    out = lines.where("order_month is not null").withColumn("s", F.explode(both))
    return out.withColumn("snapshot_id", F.col("s.snapshot_id")).withColumn("month_key", F.col("s.month")).drop("s", "order_month")


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).groupBy("site_code", "product_number", "month_key", "snapshot_id").agg(F.sum("total_qty").alias("demand_qty"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    n = part.select(F.count(F.lit(1)).alias("n_parts"))
    p = F.col("p_partkey")
    parent, third = p % 5 == 0, p % 10 == 0
    out = part.join(F.broadcast(n), F.col("n_parts") > 0)  # one row
    child = lambda a, b, on: F.when(on, 1 + (a * p + b) % F.col("n_parts"))
    return out.select(
        p.alias("product_number"), F.col("p_type").alias("product_family"), F.col("p_brand").alias("platform"), F.when(F.col("p_size") <= 5, "NPI").otherwise("OLD").alias("product_status"),
        F.when(parent, 1).otherwise(0).alias("is_parent"), F.when(parent, 1).otherwise(0).alias("has_children"),
        child(7, 1, parent).alias("child_product_1"), F.when(parent, 1.0 + p % 4).alias("quantity_child_1"),
        child(11, 3, parent).alias("child_product_2"), F.when(parent, 1.0 + (p + 1) % 4).alias("quantity_child_2"),
        child(13, 5, third).alias("child_product_3"), F.when(third, 2.0).alias("quantity_child_3"),
    )


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_children(products(spark, sf_dir), "product_number")


def cells(lines: DataFrame, dealt_by: str) -> DataFrame:
    """Quantity, times, yield and validity per site, product, test type, month and snapshot, in one aggregate of lines dealt by one of these."""
    out = snapshots_of(lines).repartition(dealt_by).groupBy("site_code", "product_number", "test_type", "month_key", "snapshot_id")
    return out.agg(
        F.sum("total_qty").alias("qty"), F.avg("test_time_sec").alias("target_test_time_sec"), F.avg("handling_time_sec").alias("handling_time_sec"),
        F.min("factory_code").alias("factory_code"), (F.count_if(F.col("order_key") % 101 == 0) == 0).alias("is_valid"), F.avg("yield_avg").alias("target_yield"),
    )


def test_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = snapshots(spark, sf_dir).groupBy("site_code", "product_number", "test_type", "month_key", "snapshot_id")
    return out.agg(F.avg("test_time_sec").alias("target_test_time_sec"), F.avg("handling_time_sec").alias("handling_time_sec"), F.min("factory_code").alias("factory_code"), (F.count_if(F.col("order_key") % 101 == 0) == 0).alias("is_valid"))


def target_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).groupBy("site_code", "product_number", "test_type", "month_key", "snapshot_id").agg(F.avg("yield_avg").alias("target_yield"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory_of(fact(spark, sf_dir))


def inventory_of(fact: DataFrame) -> DataFrame:
    """Equipment present at a site in a month: its suppliers with shipments, each of which serves one test type."""
    own = F.element_at(F.array(*[F.lit(t) for t in TEST_TYPES]), (F.col("factory_code") % 6 + 1).cast("int"))
    out = fact.where(F.col("test_type") == own).groupBy("site_code", "test_type", "month_key", F.col("factory_code").alias("equipment_id"))
    kind = F.when(F.col("equipment_id") % 2 == 0, "SYSTEM").otherwise("FIXTURE")
    out = out.agg(F.max("equip_qty").alias("equip_qty_available"), F.avg("utilization_rate").alias("utilization_rate"))
    e = F.col("equipment_id")
    return out.withColumns({"equipment_type": kind, "yield_retest_1": 0.7 + (e % 3) / 20, "yield_retest_2_plus": 0.85 + (e % 2) / 20, "retest_quote": 0.7 + (e % 4) / 40})


def site_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_params_of(fact(spark, sf_dir))


def site_params_of(fact: DataFrame) -> DataFrame:
    """Shifts, hours and allowances of a site and month."""
    months = fact.select("site_code", "region_no", "month_key").distinct()
    r, m = F.col("region_no"), F.col("month_key") % 3
    return months.select(
        "site_code", "month_key", (20 + r % 3 + m).alias("working_days_normal"), (26 + r % 3 + m).alias("working_days_max"), F.lit(2).alias("shifts_per_day_normal"), F.lit(3).alias("shifts_per_day_max"),
        F.lit(8.0).alias("hours_per_shift_normal"), (8.0 + r % 2).alias("hours_per_shift_max"), (0.05 + r / 100).alias("allowance_pct"), (0.95 - r / 100).alias("productivity_pct"),
    )


def test_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("test_type")).distinct()
    return t.withColumns({"test_category_id": F.concat(F.lit("C-"), "test_type"), "test_category_name": F.lower("test_type")})


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry per factory, product, test type and day."""
    f = fact(spark, sf_dir)
    d = F.dayofmonth("execution_date")
    return f.select(
        "site_code", "factory_code", "product_number", "product_family", "test_type", "month_key", "execution_date", "total_qty", "failed_qty", (F.col("total_qty") - F.col("failed_qty")).alias("passed_qty"), "yield_avg",
        F.col("test_time_sec").alias("test_duration_avg_sec"), F.col("handling_time_sec").alias("handling_time_avg_sec"), (10.0 * d).alias("idle_time_avg_sec"),
        (100.0 * (F.col("factory_code") % 7) + 50 * d).alias("equipment_downtime_avg_sec"), (20.0 + F.col("total_qty")).alias("actual_throughput_uph"),
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series (site, family, test type) and month."""
    return fact(spark, sf_dir).groupBy(*SERIES, "month_key").agg(
        F.sum("total_qty").alias("demand_qty"), F.avg("yield_avg").alias("target_yield"), F.avg("test_time_sec").alias("target_test_time_sec"), F.avg("utilization_rate").alias("utilization_rate")
    )


#: What the functions above compute, as SQL over the same tables.
SQL_VIEWS = {
    "sites": "SELECT n_nationkey AS nation_key, n_name AS site_code, r_name AS region, CAST(r_regionkey AS BIGINT) AS region_no FROM nation JOIN region ON n_regionkey = r_regionkey",
    "fact": """SELECT site_code, region, region_no, l_suppkey AS factory_code, l_partkey AS product_number, p_type AS product_family, p_brand AS platform,
        CASE WHEN p_size <= 5 THEN 'NPI' ELSE 'OLD' END AS product_status, l_returnflag || l_linestatus AS test_type,
        CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS month_key, CAST(l_shipdate AS DATE) AS execution_date, l_quantity AS total_qty,
        round(l_quantity * l_discount, 4) AS failed_qty, CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE round(1 - l_discount, 2) END AS yield_avg, round(1 - l_tax, 2) AS utilization_rate,
        10.0::DOUBLE + p_size AS handling_time_sec, 5.0::DOUBLE * l_quantity AS test_time_sec, 1 + l_suppkey % 4 AS equip_qty, l_orderkey AS order_key, l_linenumber AS line_number
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN sites ON s_nationkey = nation_key""",
    "snapshots": """SELECT f.* EXCLUDE (month_key), s.snapshot_id, CASE WHEN s.snapshot_id = 'S1' THEN CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) ELSE f.month_key END AS month_key
        FROM fact f JOIN orders ON order_key = o_orderkey, (VALUES ('S1'), ('S2')) AS s(snapshot_id)""",
    "demand": "SELECT site_code, product_number, month_key, snapshot_id, sum(total_qty) AS demand_qty FROM snapshots GROUP BY ALL",
    "products": """SELECT p_partkey AS product_number, p_type AS product_family, p_brand AS platform, CASE WHEN p_size <= 5 THEN 'NPI' ELSE 'OLD' END AS product_status,
        CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS is_parent, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS has_children,
        CASE WHEN p_partkey % 5 = 0 THEN 1 + (7 * p_partkey + 1) % n END AS child_product_1, CASE WHEN p_partkey % 5 = 0 THEN 1.0::DOUBLE + p_partkey % 4 END AS quantity_child_1,
        CASE WHEN p_partkey % 5 = 0 THEN 1 + (11 * p_partkey + 3) % n END AS child_product_2, CASE WHEN p_partkey % 5 = 0 THEN 1.0::DOUBLE + (p_partkey + 1) % 4 END AS quantity_child_2,
        CASE WHEN p_partkey % 10 = 0 THEN 1 + (13 * p_partkey + 5) % n END AS child_product_3, CASE WHEN p_partkey % 10 = 0 THEN 2.0::DOUBLE END AS quantity_child_3
        FROM part, (SELECT count(*) AS n FROM part)""",
    "hierarchy": """SELECT product_number, 1 AS child_seq, child_product_1 AS child_product, quantity_child_1 AS child_quantity FROM products WHERE child_product_1 IS NOT NULL
        UNION ALL SELECT product_number, 2, child_product_2, quantity_child_2 FROM products WHERE child_product_2 IS NOT NULL
        UNION ALL SELECT product_number, 3, child_product_3, quantity_child_3 FROM products WHERE child_product_3 IS NOT NULL""",
    "all_demand": """SELECT d.*, product_family, platform, product_status, is_parent, has_children, NULL::BIGINT AS parent_product_number, 1.0::DOUBLE AS child_quantity, demand_qty AS effective_demand_qty, NULL::DOUBLE AS parent_demand_qty
        FROM demand d LEFT JOIN products p USING (product_number)
        UNION ALL BY NAME SELECT d.site_code, h.child_product AS product_number, d.month_key, d.snapshot_id, d.demand_qty, p.product_family, p.platform, p.product_status, p.is_parent, p.has_children,
        d.product_number AS parent_product_number, h.child_quantity, d.demand_qty * h.child_quantity AS effective_demand_qty, d.demand_qty AS parent_demand_qty
        FROM demand d JOIN hierarchy h ON d.product_number = h.product_number JOIN products p ON p.product_number = h.child_product""",
    "test_time": """SELECT site_code, product_number, test_type, month_key, snapshot_id, avg(test_time_sec) AS target_test_time_sec, avg(handling_time_sec) AS handling_time_sec, min(factory_code) AS factory_code,
        count(*) FILTER (WHERE order_key % 101 = 0) = 0 AS is_valid FROM snapshots GROUP BY 1, 2, 3, 4, 5""",
    "target_yield": "SELECT site_code, product_number, test_type, month_key, snapshot_id, avg(yield_avg) AS target_yield FROM snapshots GROUP BY 1, 2, 3, 4, 5",
    "inventory": """SELECT site_code, test_type, month_key, factory_code AS equipment_id, max(equip_qty) AS equip_qty_available, avg(utilization_rate) AS utilization_rate,
        CASE WHEN factory_code % 2 = 0 THEN 'SYSTEM' ELSE 'FIXTURE' END AS equipment_type, 0.7::DOUBLE + (factory_code % 3) / 20 AS yield_retest_1, 0.85::DOUBLE + (factory_code % 2) / 20 AS yield_retest_2_plus,
        0.7::DOUBLE + (factory_code % 4) / 40 AS retest_quote FROM fact WHERE test_type = ['AF', 'AO', 'NF', 'NO', 'RF', 'RO'][factory_code % 6 + 1] GROUP BY 1, 2, 3, 4""",
    "site_params": """SELECT DISTINCT site_code, month_key, 20 + region_no % 3 + month_key % 3 AS working_days_normal, 26 + region_no % 3 + month_key % 3 AS working_days_max, 2 AS shifts_per_day_normal, 3 AS shifts_per_day_max,
        8.0::DOUBLE AS hours_per_shift_normal, 8.0::DOUBLE + region_no % 2 AS hours_per_shift_max, 0.05::DOUBLE + region_no / 100 AS allowance_pct, 0.95::DOUBLE - region_no / 100 AS productivity_pct FROM fact""",
    "test_types": "SELECT DISTINCT l_returnflag || l_linestatus AS test_type, 'C-' || l_returnflag || l_linestatus AS test_category_id, lower(l_returnflag || l_linestatus) AS test_category_name FROM lineitem",
    "base": f"""SELECT d.*, t.test_type, t.target_test_time_sec, t.factory_code, coalesce(t.handling_time_sec, 0.0::DOUBLE) AS handling_time_sec, coalesce(y.target_yield, 0.95::DOUBLE) AS target_yield,
        i.equipment_id, i.equipment_type, coalesce(i.equip_qty_available, 0) AS equip_qty_available, coalesce(i.utilization_rate, 0.85::DOUBLE) AS utilization_rate, i.yield_retest_1, i.yield_retest_2_plus, i.retest_quote,
        p.* EXCLUDE (site_code, month_key), s.nation_key, s.region, s.region_no, tt.test_category_id, tt.test_category_name, CASE WHEN d.month_key <= {CUTOFF} THEN 'ACTUAL' ELSE 'FORECAST' END AS data_type,
        t.factory_code || '|' || tt.test_category_id || '|' || d.product_number AS gcm_mi_join_key,
        md5(d.site_code || '|' || d.product_number || '|' || coalesce(CAST(parent_product_number AS VARCHAR), '-') || '|' || t.test_type || '|' || coalesce(CAST(i.equipment_id AS VARCHAR), '-') || '|' || d.month_key || '|' || d.snapshot_id) AS gcm_pk
        FROM (SELECT * FROM all_demand WHERE effective_demand_qty > 0) d JOIN (SELECT * FROM test_time WHERE is_valid AND target_test_time_sec > 0) t USING (site_code, product_number, month_key, snapshot_id)
        LEFT JOIN target_yield y ON y.site_code = d.site_code AND y.product_number = d.product_number AND y.test_type = t.test_type AND y.month_key = d.month_key AND y.snapshot_id = d.snapshot_id
        LEFT JOIN inventory i ON i.site_code = d.site_code AND i.test_type = t.test_type AND i.month_key = d.month_key
        LEFT JOIN site_params p ON p.site_code = d.site_code AND p.month_key = d.month_key LEFT JOIN sites s ON s.site_code = d.site_code LEFT JOIN test_types tt ON tt.test_type = t.test_type""",
    "cap_case": """SELECT b.*, c.capacity_mode, c.retest_type, CAST(coalesce(nullif(CASE WHEN capacity_mode = 'NORMAL' THEN working_days_normal ELSE working_days_max END, 0), 22) AS DOUBLE) AS working_days,
        CAST(coalesce(nullif(CASE WHEN capacity_mode = 'NORMAL' THEN shifts_per_day_normal ELSE shifts_per_day_max END, 0), 2) AS DOUBLE) AS shifts,
        coalesce(nullif(CASE WHEN capacity_mode = 'NORMAL' THEN hours_per_shift_normal ELSE hours_per_shift_max END, 0), 8.0::DOUBLE) AS hours, coalesce(allowance_pct, 0.1::DOUBLE) AS allowance, coalesce(nullif(productivity_pct, 0), 0.95::DOUBLE) AS productivity,
        CASE WHEN retest_type = 'TYPE1' THEN 2.0::DOUBLE ELSE (1 - coalesce(nullif(yield_retest_1, 0), 0.80::DOUBLE) + coalesce(nullif(yield_retest_2_plus, 0), 0.90::DOUBLE)) / coalesce(nullif(yield_retest_2_plus, 0), 0.90::DOUBLE) END AS retest_r,
        CASE WHEN retest_type = 'TYPE1' THEN 0.75::DOUBLE ELSE coalesce(nullif(retest_quote, 0), 0.75::DOUBLE) END AS retest_x
        FROM base b, (VALUES ('NORMAL', 'TYPE1'), ('NORMAL', 'TYPE2'), ('MAXIMUM', 'TYPE1'), ('MAXIMUM', 'TYPE2')) AS c(capacity_mode, retest_type)""",
    "cap_steps": """SELECT *, unit * equip_qty_available AS capacity_qty, CASE WHEN unit > 0 THEN effective_demand_qty / unit ELSE 9999.0::DOUBLE END AS need_fractional FROM (
        SELECT *, step3_productivity_adjusted * step4_monthly_shifts AS unit FROM (
        SELECT *, step3_productivity_raw * (1 - allowance) * productivity AS step3_productivity_adjusted, working_days * shifts AS step4_monthly_shifts FROM (
        SELECT *, coalesce(hours * 3600 / nullif(step2_total_avg_test_time, 0), 0) AS step3_productivity_raw FROM (
        SELECT *, step1_avg_test_time / least(1.0::DOUBLE, greatest(0.01::DOUBLE, utilization_rate)) AS step2_total_avg_test_time FROM (
        SELECT *, (handling_time_sec + target_test_time_sec) * (1 + (1 - least(0.99::DOUBLE, greatest(0.01::DOUBLE, target_yield))) * retest_r * retest_x) AS step1_avg_test_time FROM cap_case)))))""",
    "cap": """SELECT *, md5(gcm_pk || '|' || capacity_mode || '|' || retest_type) AS cap_pk, gap_pct > 0.15 AS is_excess, gap_qty < 0 AS is_bottleneck,
        CASE WHEN gap_pct > 0.15 THEN 'EXCESS' WHEN gap_pct > 0.05 THEN 'BALANCED' WHEN gap_pct >= 0 THEN 'LOW' WHEN gap_pct >= -0.03 THEN 'MEDIUM' WHEN gap_pct >= -0.08 THEN 'HIGH' ELSE 'CRITICAL' END AS bottleneck_severity,
        greatest(need_ceiling - equip_qty_available, 0) AS investment_need_units, greatest(equip_qty_available - need_ceiling, 0) AS excess_capacity_units FROM (
        SELECT *, capacity_qty - effective_demand_qty AS gap_qty, CASE WHEN effective_demand_qty > 0 THEN (capacity_qty - effective_demand_qty) / effective_demand_qty ELSE 0 END AS gap_pct,
        CASE WHEN capacity_qty > 0 THEN effective_demand_qty / capacity_qty ELSE 'inf'::DOUBLE END AS utilization_pct, CAST(ceil(need_fractional) AS BIGINT) AS need_ceiling FROM cap_steps)""",
    "daily": """SELECT site_code, factory_code, product_number, product_family, test_type, month_key, execution_date, total_qty, failed_qty, total_qty - failed_qty AS passed_qty, yield_avg, test_time_sec AS test_duration_avg_sec,
        handling_time_sec AS handling_time_avg_sec, 10.0::DOUBLE * day(execution_date) AS idle_time_avg_sec, 100.0::DOUBLE * (factory_code % 7) + 50 * day(execution_date) AS equipment_downtime_avg_sec,
        20.0::DOUBLE + total_qty AS actual_throughput_uph FROM fact""",
    "monthly": """SELECT site_code, product_family, test_type, month_key, sum(total_qty) AS demand_qty, avg(yield_avg) AS target_yield, avg(test_time_sec) AS target_test_time_sec, avg(utilization_rate) AS utilization_rate
        FROM fact GROUP BY 1, 2, 3, 4""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """body as a query with just the views that it needs, directly or through others, in order."""
    views = SQL_VIEWS | (extra or {})
    names = list(views)
    needed: set[str] = set()

    def need(text: str) -> None:
        for n in names:
            if n not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b|,\s*{n}\b(?!\s*[.(])", text):
                needed.add(n)
                need(views[n])

    need(body)
    return ("WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in names if n in needed) + "\n" if needed else "") + body
