"""Figures from folded planning rows against those of the rows that they unfold to."""

import pytest
from pyspark.sql import functions as F

from planforge.operators import analytics as N
from planforge.operators import capacity as K
from planforge.operators import pairs as PR
from planforge.operators import planning as P
from planforge.operators.quantiles import exact_quantiles, quantiles_of_counts


@pytest.fixture(scope="module")
def folded(spark):
    """A cell of 40 products, two of them planned twice, and 30 machines, one without equipment, and one whose parameters are missing."""
    rows = [("A", t, 199601, "S1", p, None if k == 0 else 900 + k, float(1 + p * p * 400), 5.0 + p, 10.0, 0.9 if p % 3 else 0.0) for t in ("AF", "NO", "RO") for p in range(40) for k in range(2 if p < 2 else 1)]
    plans = spark.createDataFrame(rows, "site_code string, test_type string, month_key int, snapshot_id string, product_number long, parent_product_number long, effective_demand_qty double, target_test_time_sec double, handling_time_sec double, target_yield double").withColumn("factory_code", F.lit(1).cast("long"))
    machines = [("A", t, 199601, e, "SYSTEM" if e % 2 else "FIXTURE", e % 4 + 1, 0.5 + e / 100, 0.0 if e == 3 else 0.7, 0.85, None if e == 4 else 0.75) for t in ("AF", "RO") for e in range(30)]
    gear = spark.createDataFrame(machines, "site_code string, test_type string, month_key int, equipment_id long, equipment_type string, equip_qty_available long, utilization_rate double, yield_retest_1 double, yield_retest_2_plus double, retest_quote double")
    sizes = plans.groupBy(*P.CELL).agg((F.count("*") * 10).alias("n"))  # several folded rows a cell
    out = P.folded(plans, gear, sizes).withColumn("test_category_id", F.lit("C"))
    there = F.col("test_type") != "RO"
    numbers = {"working_days": 20, "shifts_per_day": 2, "hours_per_shift": 8.0}
    return out.withColumns({f"{k}_{m}": F.when(there, v) for k, v in numbers.items() for m in ("normal", "max")} | {"allowance_pct": F.when(there, 0.05), "productivity_pct": F.when(there, 0.9)}).cache()


def same(got, expected, keys):
    names = sorted(set(got.columns) & set(expected.columns))
    a, b = (sorted(([r[c] for c in names] for r in df.select(*names).collect()), key=lambda r: [str(r[names.index(k)]) for k in keys]) for df in (got, expected))
    assert len(a) == len(b) and len(names) > len(keys)
    for x, y in zip(a, b, strict=True):
        assert x == [pytest.approx(v, rel=1e-12) if isinstance(v, float) else v for v in y]


def test_rows_grow_with_the_sum_of_plans_and_equipment(folded):
    assert P.unfolded(folded).count() == 42 * (30 + 30 + 1)
    assert folded.select(F.sum(F.size("plans"))).first()[0] == 42 * 3 and folded.count() > 3


def test_sums_of_pairs(folded):
    c = K.capacity_modes(P.unfolded(folded))
    cells = PR.cells(folded)
    same(PR.bottlenecks(cells, N.GAP_KEYS), N.bottlenecks(c), [*N.GAP_KEYS, "equipment_type"])
    keys = ["site_code", "test_type", "capacity_mode", "retest_type"]
    rows = c.groupBy(*keys, "bottleneck_severity").count().groupBy(*keys).pivot("bottleneck_severity").sum("count").na.fill(0)
    got = cells.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in rows.columns if s not in keys])
    same(got, rows, keys)
    assert len(rows.columns) > 6  # several severities


def test_uses_of_equipment(folded):
    keys = ["test_type", "equipment_id", "capacity_mode", "retest_type"]
    rows = K.capacity_modes(P.unfolded(folded)).where("capacity_qty > 0").groupBy(*keys).agg(F.sum("utilization_pct").alias("u"), F.max("utilization_pct").alias("most"), F.min("utilization_pct").alias("least"), F.sum("effective_demand_qty").alias("d"))
    got = PR.uses(folded).groupBy(*keys).agg(F.sum("use_sum").alias("u"), F.max("use_max").alias("most"), F.min("use_min").alias("least"), F.sum("demand_sum").alias("d"))
    same(got, rows, keys)


def test_parity_counts(folded):
    out = N.demand_vs_capacity(K.capacity_modes(P.unfolded(folded)), parity=True)
    same(N.parity_counts(folded), out.groupBy("site_code", "snapshot_id").agg(F.count("*").alias("n"), F.count("max_capacity_qty").alias("matched")), ["site_code", "snapshot_id"])


def test_quantiles_from_counts(folded):
    wanted = {c: (c, 0.5) for c in ("effective_demand_qty", "equip_qty_available", "utilization_rate", "target_yield")}
    parts = [(P.plans_of(folded), "n_rows", ["effective_demand_qty", "target_yield"]), (P.equipment_of(folded), "n_rows", ["equip_qty_available", "utilization_rate"])]
    same(quantiles_of_counts(parts, ["test_type"], wanted), exact_quantiles(P.unfolded(folded), ["test_type"], wanted), ["test_type"])


def test_plan_of_actuals_is_one_aggregate_of_one_snapshot(spark, sf_dir):
    from planforge.queries import rollups

    plan = rollups._plan(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Generate" not in plan


def test_tasks_of_actuals_grow_with_the_table(spark, sf_dir, monkeypatch):
    from planforge.queries import rollups
    from planforge.sources import io

    monkeypatch.setattr(rollups, "_TASK_BYTES", io.size_of(spark, f"{sf_dir}/lineitem.parquet") // 9)
    out = rollups.e11_parity_all_months(spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(site_code" in line]
    assert len(dealt) == 2 and all(", REPARTITION_BY_NUM" in line and ", 10)" in line for line in dealt)  # one shuffle a side


def test_uses_from_sums(folded):
    """The same uses without a figure per pair, and the plan has no Python."""
    keys = ["test_type", "equipment_id", "capacity_mode", "retest_type"]
    rows = PR.uses(folded).groupBy(*keys).agg(F.sum("use_sum").alias("use_sum"), F.max("use_max").alias("use_max"), F.min("use_min").alias("use_min"), F.sum("demand_sum").alias("demand_sum"), F.sum("n").alias("n"))
    got = PR.summed_uses(folded)
    same(got.drop("use_max", "use_min"), rows, keys)
    same(got.where("retest_type = 'TYPE1'"), rows.where("retest_type = 'TYPE1'"), keys)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_matrices_are_of_classes_and_bounded(monkeypatch):
    """Plans and equipment of the same parameters are worked out once, a few classes of equipment at a time."""
    import numpy as np
    import pyarrow as pa

    n, m = 400, 900
    shifts = {f"{c}_{k}": [8.0] for k in ("NORMAL", "MAXIMUM") for c in ("working_days", "shifts", "hours")}
    plans = {"product_number": [list(range(n))], "effective_demand_qty": [[float(i % 7) for i in range(n)]], "handling_time_sec": [[5.0] * n], "target_test_time_sec": [[20.0] * n], "target_yield": [[0.9] * n]}
    gear = {"id": [list(range(m))], "kind": [["A", "B"] * (m // 2)], "qty": [[float(i % 4) for i in range(m)]], "utilization_rate": [[0.5 + (i % 300) / 1000 for i in range(m)]], "yield_retest_1": [[0.7] * m], "yield_retest_2_plus": [[0.9] * m], "retest_quote": [[None] * m]}
    b = pa.RecordBatch.from_pydict({"site_code": ["S"], "test_type": ["AF"], "month_key": [199601], "snapshot_id": ["S1"], **shifts, "allowance": [0.1], "productivity": [0.9], **plans, **gear}).cast(
        pa.schema([("site_code", pa.string()), ("test_type", pa.string()), ("month_key", pa.int32()), ("snapshot_id", pa.string()), *[(c, pa.float64()) for c in (*shifts, "allowance", "productivity")], ("product_number", pa.list_(pa.int64())), *[(c, pa.list_(pa.float64())) for c in list(plans)[1:]], ("id", pa.list_(pa.int64())), ("kind", pa.list_(pa.string())), *[(c, pa.list_(pa.float64())) for c in list(gear)[2:]]])
    )
    monkeypatch.setattr(PR, "_TILE", 64)
    row, ids = next(iter(PR._rows(b)))
    sizes = [x[6].shape for x in row.matrices()]
    assert max(s[0] for s in sizes) <= 64 and {s[1] for s in sizes} == {7}  # before: 900 x 400 at once
    out = list(PR._cells(row, ids))
    assert sum(x[9][0] for x in out) == 4 * n * m
    assert np.isclose(sum(x[PR._CELLS.split(", ").index("demand_sum double")][0] for x in out), 4 * m * sum(i % 7 for i in range(n)))


def test_first_months(folded):
    months = [folded.withColumn("month_key", F.lit(m)) for m in (199603, 199601, 199602)]
    rows, n = months[0].union(months[1]).union(months[2]), P.unfolded(folded).count()
    for wanted, last in ((1, 199601), (n, 199601), (n + 1, 199602), (2 * n, 199602), (3 * n, 199603), (9 * n, 199603)):
        assert P.first_months(rows, wanted).agg(F.max("month_key")).first()[0] == last


def test_equipment_is_taken_once_a_cell(folded):
    assert folded.count() > 3 and P.equipment_of(folded).count() == 30 + 30 + 1


def test_row_groups_are_bounded(spark, tmp_path, monkeypatch):
    """A scan decodes a row group's rows at once at most, so few long arrays are in one."""
    import glob

    import pyarrow.parquet as pq

    from planforge.sources import io

    monkeypatch.setattr(io, "ROW_GROUP", 1 << 20)
    rows = spark.range(0, 2000, 1, 1).select(F.lit(199601).alias("month_key"), F.col("id"), F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda x: F.xxhash64("id", x)).alias("v"))
    io.add_months(rows, str(tmp_path / "layer"), "month_key", ["id"])
    files = [pq.ParquetFile(f).metadata for f in glob.glob(str(tmp_path / "layer/*/*.parquet"))]
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) < 500  # one group of 2,000 before
