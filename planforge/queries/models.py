"""Queries of forecasts, models, risk, table functions and summaries (L, M, P)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planforge.functions import columns as C
from planforge.operators import analytics as N
from planforge.operators import forecast as FC
from planforge.operators import ml
from planforge.operators import pairs as PR
from planforge.operators import planning as P
from planforge.operators import risk as RK
from planforge.operators import trend as TR
from planforge.operators.capacity import with_predicted_yield
from planforge.operators.quantiles import quantiles_of_counts
from planforge.plans import adapters as A
from planforge.plans import chains, serving
from planforge.plans import functions as T
from planforge.plans import scores as SC
from planforge.plans.adapters import SERIES, table
from planforge.plans.scores import SITE
from planforge.queries.base import R, query, r, rounded
from planforge.queries.rollups import _OEE_SITE, _oee_site
from planforge.sources import io, store
from planforge.streaming.telemetry import deduplicated_stream

_SITE = {"site_months": "SELECT site_code, product_family, month_key, sum(total_qty) AS demand_qty FROM fact GROUP BY 1, 2, 3"}

# L: forecasts


@query("SELECT DISTINCT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS p_brand_code FROM part")
def l1_category_codes(spark, sf):
    return ml.category_codes(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand"])


_CROSTON = f"""SELECT factory_code, product_family, {R('a / greatest(q, 1.0)', 5)} AS croston FROM (SELECT *, CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE m + (1 - m) * pow(0.9, k - 1) END AS q FROM (
    SELECT factory_code, product_family, sum(pow(0.9, k - j) * CASE WHEN j = 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END * z) AS a, max(k) AS k, CAST(max(p) - min(p) AS DOUBLE) / nullif(max(k) - 1, 0) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY factory_code, product_family ORDER BY p) AS j, count(*) OVER (PARTITION BY factory_code, product_family) AS k FROM (
    SELECT factory_code, product_family, CAST(month_key // 100 * 12 + month_key % 100 AS INTEGER) AS p, sum(total_qty) AS z FROM fact GROUP BY 1, 2, 3)) GROUP BY 1, 2))"""


@query(_CROSTON)
def l5_croston(spark, sf):
    keys = ["factory_code", "product_family"]
    m = A.fact(spark, sf).groupBy(*keys, C.month_number("month_key").alias("p")).agg(F.sum("total_qty").alias("z"))
    return rounded(FC.croston(m, keys, "z", "p"), 5)


_TREND = """SELECT f.site_code, f.product_family, CAST((n.last_n + h) // 12 * 100 + (n.last_n + h) % 12 + 1 AS INTEGER) AS month_key,
    greatest(0, CASE WHEN f.n < 12 THEN f.mean ELSE f.base + f.slope * (n.last_n + h + 1) + coalesce(s.season, 0) END) AS trend_forecast
    FROM fits f JOIN (SELECT site_code, product_family, max(month_key // 100 * 12 + month_key % 100) - 1 AS last_n FROM site_months GROUP BY 1, 2) n USING (site_code, product_family) CROSS JOIN range(1, 7) t(h)
    LEFT JOIN seasons s ON s.site_code = f.site_code AND s.product_family = f.product_family AND s.moy = (n.last_n + h) % 12 + 1"""
_TREND_VIEWS = _SITE | {
    "fits": "SELECT site_code, product_family, regr_slope(demand_qty, month_key // 100 * 12 + month_key % 100) AS slope, regr_intercept(demand_qty, month_key // 100 * 12 + month_key % 100) AS base, count(*) AS n, avg(demand_qty) AS mean FROM site_months GROUP BY 1, 2",
    "seasons": "SELECT m.site_code, m.product_family, month_key % 100 AS moy, avg(demand_qty - (base + slope * (month_key // 100 * 12 + month_key % 100))) AS season FROM site_months m JOIN fits USING (site_code, product_family) GROUP BY 1, 2, 3",
    "trend": _TREND,
}


@query(f"SELECT site_code, product_family, month_key, {R('trend_forecast', 3)} AS trend_forecast FROM trend", _TREND_VIEWS)
def l4_seasonal_trend(spark, sf):
    return rounded(FC.seasonal_trend(SC.site_months(spark, sf), SITE, 6), 3)


@query("SELECT site_code, product_family, demand_qty, CAST(h AS INTEGER) AS horizon, CAST(strftime(make_date(month_key // 100, month_key % 100, 1) + to_months(CAST(h AS INTEGER)), '%Y%m') AS INTEGER) AS month_key FROM (SELECT * FROM site_months QUALIFY row_number() OVER (PARTITION BY site_code, product_family ORDER BY month_key DESC) = 1) CROSS JOIN range(1, 7) t(h)", _SITE)
def l6_future_frame(spark, sf):
    return FC.future_frame(SC.site_months(spark, sf), SITE, 6)


# L: models (no SQL can say them; tests hold what is read from them to DuckDB over the written tables)


@query()
def l3_demand_regressors(spark, sf):
    return SC.demand(spark, sf)("fitted")


@query()
def l4_changepoint_trend(spark, sf):
    return rounded(TR.changepoint_forecasts(TR.histories(SC.site_months(spark, sf), SITE), SITE, SC.HORIZON), 4)


@query()
def l7_ensemble(spark, sf):
    return SC.demand(spark, sf)("forecasts")


@query()
def l8_backtest(spark, sf):
    return SC.demand_accuracy(SC.demand(spark, sf)("backtest"))


@query()
def l8_rolling_origins(spark, sf):
    errors = FC.error_metrics(F.col("demand_qty"), F.col("forecast"))
    return rounded(SC.demand(spark, sf)("backtest").groupBy("origin", "horizon").agg(*errors), 4)


@query()
def f18_accuracy_summary(spark, sf):
    return rounded(T.accuracy_summary(SC.demand_accuracy(SC.demand(spark, sf)("backtest"))), 4)


@query()
def l9_yield_model(spark, sf):
    return SC.yields(spark, sf)("scores").select("feat_pk", "target_yield", "predicted_yield", "residual", "abs_error_pp")


@query()
def l9_yield_folds(spark, sf):
    return SC.yield_fold_scores(spark, sf)


@query()
def l11_attributions(spark, sf):
    return SC.yield_attributions(spark, sf)


_COLS = ["demand_lag_1", "demand_roll_avg_3", "yield_lag_1", "yield_roll_avg_3", "target_test_time_sec", "month_of_year", "utilization_rate"]


def _store(spark, sf):
    rows = N.feature_store(A.monthly(spark, sf), SERIES, A.CUTOFF).withColumn("feat_pk", C.md5_strict(*SERIES, "month_key"))
    return ml.features(rows.where("target_yield is not null"), _COLS)


@query()
def l12_oversampling(spark, sf):
    rows = _store(spark, sf).withColumn("label", F.when(F.col("demand_qty") < 10, 1).otherwise(0))
    return ml.oversample(rows, "label", _COLS, ["feat_pk"])


@query()
def l13_failure_model(spark, sf):
    return SC.failures(spark, sf)("scores")


@query()
def l13_failure_folds(spark, sf):
    return SC.failures(spark, sf)("folds")


@query()
def l14_risk_alerts(spark, sf):
    return ml.risk_alerts(SC.failures(spark, sf)("scores"))


@query()
def l16_isolation_forest(spark, sf):
    return SC.anomaly_scores(spark, sf).select(*SC.MACHINE, "month_key", "score", "is_anomaly")


@query(
    f"SELECT site_code, test_type, month_key, {R('(demand_qty - avg(demand_qty) OVER ()) / stddev_pop(demand_qty) OVER ()', 4)} AS demand_qty_z FROM (SELECT site_code, test_type, month_key, sum(demand_qty) AS demand_qty FROM monthly GROUP BY 1, 2, 3)"
)
def l15_standardize(spark, sf):
    m = A.monthly(spark, sf).groupBy("site_code", "test_type", "month_key").agg(F.sum("demand_qty").alias("demand_qty"))
    return ml.standardized(m, ["demand_qty"]).select("site_code", "test_type", "month_key", r("demand_qty_z", 4).alias("demand_qty_z"))


@query()
def l17_anomaly_tiers(spark, sf):
    return SC.anomaly_scores(spark, sf).groupBy("severity").agg(F.count("*").alias("n"))


@query()
def f15_anomaly_summary(spark, sf):
    odd = F.when(F.col("is_anomaly"), 1.0).otherwise(0.0)
    out = SC.anomaly_scores(spark, sf).groupBy("site_code")
    return rounded(out.agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("anomalies"), F.avg(odd).alias("rate"), F.avg("oee").alias("mean_oee"), F.min("oee").alias("min_oee"), F.avg("score").alias("mean_score")))


# L: risk


@query(f"SELECT site_code, product_family, test_type, {R('avg(demand_qty)')} AS demand_mean, {R('stddev_samp(demand_qty)')} AS demand_std, {R('coalesce(stddev_samp(demand_qty) / nullif(avg(demand_qty), 0), 0.15)')} AS demand_cv FROM monthly GROUP BY 1, 2, 3")
def f10_demand_uncertainty(spark, sf):
    return rounded(RK.demand_uncertainty(A.monthly(spark, sf), SERIES))


@query(
    f"SELECT factory_code, test_type, n, {R('CASE WHEN n < 5 THEN 5.0 ELSE greatest(m * s, 0.5) END', 4)} AS alpha, {R('CASE WHEN n < 5 THEN 1.0 ELSE greatest((1 - m) * s, 0.5) END', 4)} AS beta FROM (SELECT *, m * (1 - m) / v - 1 AS s FROM (SELECT factory_code, test_type, avg(yield_avg) AS m, var_pop(yield_avg) + 1e-8 AS v, count(*) AS n FROM fact WHERE yield_avg IS NOT NULL GROUP BY 1, 2))"
)
def f11_beta_moments(spark, sf):
    return rounded(RK.beta_moments(A.fact(spark, sf), ["factory_code", "test_type"], "yield_avg"), 4)


_TRI = "SELECT site_code, greatest(min(oee) - 0.05, 0.01) AS low, max(oee) AS top, least(max(oee) + 0.05, 1.0) AS high FROM oee_site GROUP BY 1"
_MODE = "SELECT site_code, mode FROM (SELECT site_code, round(oee + 1e-9, 2) AS mode, count(*) AS n FROM oee_site GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY site_code ORDER BY n DESC, mode) = 1"
_TRI_VIEWS = _OEE_SITE | {"tri_ends": _TRI, "tri_mode": _MODE}


@query(f"SELECT site_code, {R('low')} AS low, mode, {R('high')} AS high FROM tri_ends JOIN tri_mode USING (site_code)", _TRI_VIEWS)
def f12_triangular_fit(spark, sf):
    out = RK.triangular_fit(_oee_site(spark, sf), ["site_code"], "oee")
    return out.select("site_code", r("low").alias("low"), "mode", r("high").alias("high"))


DRAWS = 10_000


def _lcg(stream: int) -> str:
    x = f"((combo_no * 7919 + draw * 104729 + {stream} * 1299709 + 12345) % 2147483647)"
    for _ in range(3):
        x = f"(({x} * 48271 + 11) % 2147483647)"
    return f"((CAST({x} AS DOUBLE) + 0.5::DOUBLE) / 2147483647.0::DOUBLE)"


_PARAMETERS = {"handling_time_sec": "handling_time_sec", "target_test_time_sec": "target_test_time_sec", "utilization_rate": "utilization_rate", "shifts": "shifts_per_day_normal", "working_days": "working_days_normal", "hours": "hours_per_shift_normal", "allowance": "allowance_pct", "productivity": "productivity_pct", "current_equipment_qty": "equip_qty_available", "target_yield": "target_yield"}
_MEDIANS = "SELECT site_code, test_type, " + ", ".join(f"{R(f'median({c})')} AS {name}" for name, c in _PARAMETERS.items()) + " FROM base GROUP BY 1, 2"
_SITE_DEMAND = f"SELECT site_code, {R('max(mean)')} AS demand_mean, {R('avg(cv)')} AS demand_cv FROM (SELECT site_code, product_family, test_type, avg(demand_qty) AS mean, coalesce(stddev_samp(demand_qty) / nullif(avg(demand_qty), 0), 0.15) AS cv FROM monthly GROUP BY 1, 2, 3) GROUP BY 1"
_TYPE_YIELD = f"""SELECT test_type, {R('CASE WHEN n < 5 THEN 5.0 ELSE greatest(m * s, 0.5) END', 4)} AS alpha, {R('CASE WHEN n < 5 THEN 1.0 ELSE greatest((1 - m) * s, 0.5) END', 4)} AS beta FROM (SELECT *, m * (1 - m) / v - 1 AS s FROM (
    SELECT test_type, avg(y) AS m, var_pop(y) + 1e-8 AS v, count(*) AS n FROM (SELECT test_type, least(0.999::DOUBLE, greatest(0.01::DOUBLE, target_yield)) AS y FROM monthly WHERE target_yield IS NOT NULL) GROUP BY 1))"""
_COMBOS = f"""SELECT p.* REPLACE (coalesce(p.target_yield, 0.85::DOUBLE) AS target_yield, coalesce(allowance, 0.1::DOUBLE) AS allowance, coalesce(productivity, 0.95::DOUBLE) AS productivity), n.n_nationkey * 10 + ascii(p.test_type) % 7 + CASE WHEN p.test_type LIKE '%F' THEN 0 ELSE 3 END AS combo_no,
    coalesce(demand_mean, 500.0::DOUBLE) AS demand_mean, coalesce(demand_cv, 0.15::DOUBLE) AS demand_cv, coalesce(alpha, 5.0::DOUBLE) AS alpha, coalesce(beta, 1.0::DOUBLE) AS beta, coalesce(round(f.low + 1e-9, 6), 0.65::DOUBLE) AS low, coalesce(g.mode, 0.8::DOUBLE) AS mode, coalesce(round(f.high + 1e-9, 6), 0.95::DOUBLE) AS high
    FROM medians p JOIN nation n ON n.n_name = p.site_code LEFT JOIN site_demand d USING (site_code) LEFT JOIN type_yield y USING (test_type) LEFT JOIN tri_ends f USING (site_code) LEFT JOIN tri_mode g USING (site_code)"""


def _needs(y: str, source: str) -> str:
    oee = "least(1.0::DOUBLE, greatest(0.01::DOUBLE, CASE WHEN high <= low THEN low WHEN u < (mode - low) / (high - low) THEN low + sqrt(u * (high - low) * (mode - low)) ELSE high - sqrt((1 - u) * (high - low) * (high - mode)) END))"
    step1 = f"((handling_time_sec + target_test_time_sec) * (1 + (1 - {y}) * 2.0::DOUBLE * 0.75::DOUBLE))"
    supply = f"greatest(1e-6::DOUBLE, hours * 3600 * (1 - allowance) * productivity / ({step1} / {oee}) * (working_days * shifts))"
    draws = f"SELECT *, {_lcg(5)} AS u, {_lcg(6)} AS v, greatest(0, demand_mean + demand_mean * demand_cv * (sqrt(-2 * ln({_lcg(1)})) * cos(2 * 3.141592653589793::DOUBLE * {_lcg(2)}))) AS demand FROM combos CROSS JOIN range(1, {DRAWS + 1}) d(draw)"
    return f"SELECT *, CAST(ceil(demand / {supply}) AS BIGINT) AS need FROM ({draws}) {source}"


_SIZED = "SELECT site_code, test_type, {0} AS p50_need, {1} AS p80_need, {2} AS p95_need, {3} AS mean_need, count(*) AS draws FROM ".format(*[R(e, 4) for e in ("quantile_cont(need, 0.5)", "quantile_cont(need, 0.8)", "quantile_cont(need, 0.95)", "avg(need)")])
_COST = "CASE WHEN test_type LIKE 'A%' THEN 250000.0::DOUBLE ELSE 120000.0::DOUBLE END"
_SPEND = f"SELECT s.*, current_equipment_qty, {_COST} AS equipment_unit_cost_usd, demand_mean, greatest(p80_need - current_equipment_qty, 0) AS delta_units_p80, round(greatest(p80_need - current_equipment_qty, 0) * {_COST}) AS capex_usd_p80 FROM sizes s JOIN combos c USING (site_code, test_type)"
_CASES = f"""SELECT z.site_code, z.test_type, scenario, threshold, {R('sum(CASE WHEN need <= threshold THEN 1 ELSE 0 END) / count(*)', 5)} AS probability_sufficient, round(greatest(threshold - max(current_equipment_qty), 0) * max({_COST.replace('test_type', 'z.test_type')})) AS capex_usd
    FROM (SELECT site_code, test_type, unnest(['CONSERVATIVE', 'BALANCED', 'LEAN']) AS scenario, unnest([p95_need, p80_need, p50_need]) AS threshold FROM sizes) z JOIN needs USING (site_code, test_type) GROUP BY 1, 2, 3, 4"""
_GRID = f"""SELECT test_type, i, CAST(round(exp(l - max(l) OVER (PARTITION BY test_type)) * 1e9) AS BIGINT) AS w FROM (SELECT test_type, i, (alpha - 1) * ln((i + 0.5::DOUBLE) / {RK.CELLS}.0::DOUBLE) + (beta - 1) * ln(1 - (i + 0.5::DOUBLE) / {RK.CELLS}.0::DOUBLE) AS l
    FROM (SELECT DISTINCT test_type, alpha, beta FROM combos) CROSS JOIN range(0, {RK.CELLS}) g(i))"""
_LEVELS = f"""SELECT test_type, k, min((i + 0.5::DOUBLE) / {RK.CELLS}.0::DOUBLE) AS y FROM (SELECT *, sum(w) OVER (PARTITION BY test_type ORDER BY i) AS upto, sum(w) OVER (PARTITION BY test_type) AS total FROM grid) CROSS JOIN range(0, {RK.LEVELS}) r(k)
    WHERE 2 * {RK.LEVELS} * upto >= (2 * k + 1) * total GROUP BY 1, 2"""
_MC = _TRI_VIEWS | {"medians": _MEDIANS, "site_demand": _SITE_DEMAND, "type_yield": _TYPE_YIELD, "combos": _COMBOS, "needs": _needs("target_yield", ""), "sizes": _SIZED + "needs GROUP BY 1, 2", "cases": _CASES, "spend": _SPEND}
_MC_SAMPLED = _MC | {"grid": _GRID, "levels": _LEVELS, "sampled": _needs("y", f"JOIN levels USING (test_type) WHERE levels.k = least({RK.LEVELS - 1}, CAST(floor(v * {RK.LEVELS}) AS BIGINT))")}


def _combos(spark, sf):
    """What the simulation takes for each site and test type: medians of the planning base, demand and availability of the site, the yield of the test type."""
    fits = RK.triangular_fit(_oee_site(spark, sf), ["site_code"], "oee").select("site_code", r("low").alias("low"), "mode", r("high").alias("high"))
    per = RK.demand_uncertainty(A.monthly(spark, sf), SERIES).groupBy("site_code").agg(r(F.max("demand_mean")).alias("demand_mean"), r(F.avg("demand_cv")).alias("demand_cv"))
    y = A.monthly(spark, sf).where("target_yield is not null").select("test_type", C.clip(F.col("target_yield"), 0.01, 0.999).alias("y"))
    beta = rounded(RK.beta_moments(y, ["test_type"], "y"), 4).drop("n")
    out = RK.simulation_inputs(_medians(spark, sf), per, beta, fits)
    code = F.ascii("test_type") % 7 + F.when(F.col("test_type").endswith("F"), 0).otherwise(3)
    return out.join(F.broadcast(A.sites(spark, sf).select("site_code", "nation_key")), "site_code").withColumn("combo_no", (F.col("nation_key") * 10 + code).cast("bigint")).drop("nation_key")


def _medians(spark, sf):
    keys = ["site_code", "test_type"]
    folded, gear = chains.folded(spark, sf), ["equip_qty_available", "utilization_rate"]
    plans = (P.plans_of(folded), "n_rows", [c for c in _PARAMETERS.values() if c not in gear])
    return rounded(quantiles_of_counts([plans, (P.equipment_of(folded), "n_rows", gear)], keys, {name: (c, 0.5) for name, c in _PARAMETERS.items()}))


def _simulation(spark, sf):
    """Tables of the simulation, run once for the present tables: inputs, and how many draws have each need."""

    def build():
        inputs = io.overwrite(_combos(spark, sf), io.scratch(spark, "simulation-inputs"))
        counts = RK.need_counts(RK.monte_carlo_need(inputs, DRAWS), ["site_code", "test_type"])
        levels = RK.beta_levels(inputs.select("test_type", "alpha", "beta").distinct(), ["test_type"])
        sampled = RK.need_counts(RK.monte_carlo_need(inputs, DRAWS, levels), ["site_code", "test_type"])
        return {"inputs": inputs, "counts": counts, "sampled": sampled}, {"draws": DRAWS}

    return SC.stored(spark, sf, "simulation", (DRAWS, RK.DEFAULTS, RK.LEVELS, RK.CELLS), build)


def _sizes(spark, sf, counts="counts"):
    return rounded(RK.size_summary(_simulation(spark, sf)(counts), ["site_code", "test_type"]), 4)


def _unit_cost():
    return F.when(F.col("test_type").startswith("A"), 250000.0).otherwise(120000.0)


def _spend(spark, sf):
    current = _simulation(spark, sf)("inputs").select("site_code", "test_type", "current_equipment_qty", "demand_mean")
    return RK.investment(_sizes(spark, sf), current, ["site_code", "test_type"], _unit_cost())


def _cases(spark, sf):
    keys, read = ["site_code", "test_type"], _simulation(spark, sf)
    out = RK.scenarios(read("counts"), _sizes(spark, sf), keys).join(read("inputs").select(*keys, "current_equipment_qty"), keys)
    capex = F.round(F.greatest(F.col("threshold") - F.col("current_equipment_qty"), F.lit(0.0)) * _unit_cost())
    return out.select(*keys, "scenario", "threshold", r("probability_sufficient", 5).alias("probability_sufficient"), capex.alias("capex_usd"))


@query(_MEDIANS)
def f13_parameter_medians(spark, sf):
    return _medians(spark, sf)


_INPUTS = [*_PARAMETERS, "combo_no", "demand_mean", "demand_cv", "alpha", "beta", "low", "mode", "high"]


@query(f"SELECT site_code, test_type, {', '.join(_INPUTS)} FROM combos", _MC)
def e14_simulation_inputs(spark, sf):
    return _simulation(spark, sf)("inputs").select("site_code", "test_type", *_INPUTS)


@query("SELECT site_code, test_type, CAST(draw AS INTEGER) AS draw, need FROM needs", _MC)
def l18_monte_carlo(spark, sf):
    return RK.monte_carlo_need(_simulation(spark, sf)("inputs"), DRAWS).select("site_code", "test_type", "draw", "need")


@query(_SIZED + "sampled GROUP BY 1, 2", _MC_SAMPLED)
def l18_sampled_yield(spark, sf):
    return _sizes(spark, sf, "sampled")


@query("SELECT * FROM spend", _MC)
def l19_size_summary(spark, sf):
    return _spend(spark, sf)


@query("SELECT * FROM cases", _MC)
def l20_scenarios(spark, sf):
    return _cases(spark, sf)


@query()
def l21_saved_model(spark, sf):
    """Each saved model with what its metadata says and the size of its trees. Those that are not there yet are fitted side by side: a fit is a row of short jobs."""
    builds, out = {"demand": SC.demand, "failure": SC.failures, "yield": SC.yields}, []
    with ThreadPoolExecutor(len(builds)) as pool:
        reads = dict(zip(builds, pool.map(lambda build: build(spark, sf), builds.values()), strict=True))
    for name, read in reads.items():
        trees, meta = read("trees"), store.of_data(spark, sf).metadata(name)
        sizes = trees.groupBy("model").agg(F.count_distinct("tree").alias("trees"), F.count("*").alias("nodes"), F.count_if(F.col("feature").isNull()).alias("leaves"), F.max("base").alias("base"))
        out.append(sizes.select(F.lit(name).alias("entry"), "model", F.lit(meta["target"]).alias("target"), F.lit(len(meta["features"])).alias("n_features"), "trees", "nodes", "leaves", r("base").alias("base")))
    return out[0].unionByName(out[1]).unionByName(out[2])


# M: table functions

_SUMMARY = f"SELECT site_code, test_type, month_key, capacity_mode, {R('sum(capacity_qty)', 2)} AS capacity, sum(effective_demand_qty) AS demand, {R('avg(gap_pct)', 4)} AS avg_gap_pct, CAST(sum(investment_need_units) AS BIGINT) AS units, count(*) FILTER (WHERE is_bottleneck) AS bottlenecks FROM cap"


@query(_SUMMARY + " WHERE site_code = 'NATION_7' AND month_key BETWEEN 199701 AND 199812 GROUP BY 1, 2, 3, 4 ORDER BY 1, 3, 2, 4 LIMIT 100")
def m1_capacity_summary(spark, sf):
    out = T.capacity_summary(chains.folded(spark, sf), site="nation_7", first=199701, last=199812, limit=100)
    return out.withColumns({"capacity": r("capacity", 2), "avg_gap_pct": r("avg_gap_pct", 4)})


_BOT = """SELECT site_code, month_key, snapshot_id, capacity_mode, retest_type, test_type, equipment_type, min(gap_pct) AS min_gap_pct, CASE WHEN min(gap_pct) < -.15 THEN 'CRITICAL' WHEN min(gap_pct) < -.08 THEN 'HIGH' WHEN min(gap_pct) < -.03 THEN 'MEDIUM' WHEN min(gap_pct) < 0 THEN 'LOW' WHEN min(gap_pct) < .05 THEN 'BALANCED' ELSE 'EXCESS' END AS bottleneck_severity FROM cap GROUP BY 1, 2, 3, 4, 5, 6, 7"""


@query(f"SELECT site_code, month_key, snapshot_id, capacity_mode, retest_type, test_type, equipment_type, {R('min_gap_pct')} AS min_gap_pct FROM (SELECT * FROM bottleneck WHERE bottleneck_severity = 'EXCESS' AND month_key >= 199601 ORDER BY min_gap_pct, site_code, month_key, snapshot_id, capacity_mode, retest_type, test_type, equipment_type LIMIT 1000)", {"bottleneck": _BOT})
def m2_bottleneck_analysis(spark, sf):
    out = T.bottleneck_analysis(PR.bottlenecks(PR.cells(T.filtered(chains.folded(spark, sf), at_least={"month_key": 199601})), N.GAP_KEYS), severity="excess", first=199601, limit=3000)
    return out.select("site_code", "month_key", "snapshot_id", "capacity_mode", "retest_type", "test_type", "equipment_type", r("min_gap_pct").alias("min_gap_pct"))


@query(f"SELECT cap_pk, month_key, {R('capacity_qty', 3)} AS capacity_qty, effective_demand_qty FROM cap WHERE capacity_mode = 'NORMAL' AND site_code = 'NATION_2' ORDER BY month_key, cap_pk LIMIT 300")
def m3_demand_vs_supply(spark, sf):
    rows = P.first_months(T.filtered(chains.folded(spark, sf), {"site_code": "nation_2"}), 300)
    out = T.demand_vs_supply(chains.both_modes(P.unfolded(rows)), site="nation_2", limit=300)
    return out.select("cap_pk", "month_key", r("capacity_qty", 3).alias("capacity_qty"), "effective_demand_qty")


_USE = "SELECT site_code, test_type, equipment_id, month_key, capacity_mode, round(avg(utilization_pct) + 1e-9, 6) AS avg_utilization FROM cap WHERE capacity_qty > 0 GROUP BY 1, 2, 3, 4, 5"


@query("SELECT * FROM usage WHERE site_code = 'NATION_4' ORDER BY avg_utilization DESC, site_code, test_type, equipment_id, month_key, capacity_mode LIMIT 500", {"usage": _USE})
def m4_equipment_utilization(spark, sf):
    rows = T.filtered(chains.folded(spark, sf), {"site_code": "nation_4"})
    u = PR.summed_uses(rows).groupBy("site_code", "test_type", "equipment_id", "month_key", "capacity_mode").agg(r(F.sum("use_sum") / F.sum("n")).alias("avg_utilization"))
    return T.equipment_utilization(u, site="nation_4", limit=5000)


@query()
def m5_yield_prediction(spark, sf):
    rows = SC.yields(spark, sf)("scores").select(*SERIES, "month_key", "target_yield", "predicted_yield", "residual")
    return rounded(T.yield_prediction(rows, test_type="no", first=199801, last=199912, limit=9999), 5)


@query()
def m6_yield_drivers(spark, sf):
    return rounded(T.yield_drivers(SC.yield_attributions(spark, sf), SC.yields(spark, sf)("scores"), "feat_pk", site="nation_3"), 5)


@query()
def m7_adjusted_capacity(spark, sf):
    rows = P.first_months(T.filtered(chains.folded(spark, sf), {"site_code": "nation_5", "test_type": "no"}), 400)
    adjusted = with_predicted_yield(P.unfolded(rows), SC.yields(spark, sf)("scores").select(*SERIES, "month_key", "predicted_yield"), [*SERIES, "month_key"])
    out = T.adjusted_capacity(adjusted, site="nation_5", test_type="no", limit=400)
    return out.select("gcm_pk", "month_key", "equip_qty_available", r("capacity_qty", 3).alias("capacity_qty"), r("ml_utilization_ratio", 5).alias("ml_utilization_ratio"), r("ml_gap_pct", 3).alias("ml_gap_pct"), "yield_source")


@query()
def m8_maintenance_alerts(spark, sf):
    return T.maintenance_alerts(SC.failures(spark, sf)("scores"), test_type="af")


@query()
def m9_failure_risk_trend(spark, sf):
    return T.failure_risk_trend(SC.failures(spark, sf)("scores"), first=199601).withColumn("avg_probability", r("avg_probability", 5))


@query()
def m10_demand_forecast(spark, sf):
    return T.demand_forecast(SC.demand(spark, sf)("forecasts"), family="promo", method="ensemble", limit=120)


@query()
def m11_forecast_accuracy(spark, sf):
    return T.forecast_accuracy(SC.demand_accuracy(SC.demand(spark, sf)("backtest")), site="nation_3")


@query("SELECT * FROM spend ORDER BY capex_usd_p80 DESC, site_code, test_type LIMIT 60", _MC)
def m12_capex_recommendation(spark, sf):
    return T.capex_recommendation(_spend(spark, sf), limit=60)


@query("SELECT sum(capex_usd_p80) AS total_p80_spend, count(*) FILTER (WHERE delta_units_p80 > 0) AS combos FROM spend", _MC)
def f21_capex_total(spark, sf):
    return _spend(spark, sf).agg(F.sum("capex_usd_p80").alias("total_p80_spend"), F.count_if(F.col("delta_units_p80") > 0).alias("combos"))


@query("SELECT * FROM cases ORDER BY site_code, test_type, CASE scenario WHEN 'CONSERVATIVE' THEN 1 WHEN 'BALANCED' THEN 2 ELSE 3 END LIMIT 90", _MC)
def m13_capex_scenarios(spark, sf):
    return T.capex_scenarios(_cases(spark, sf), limit=90)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20")
def m14_table_preview(spark, sf):
    return serving.capped(table(spark, sf, "part").select("p_partkey", "p_name"), [F.col("p_partkey")], 50, 20)


@query("SELECT order_key, line_number, total_qty FROM (SELECT *, row_number() OVER (ORDER BY total_qty DESC, order_key, line_number) AS rn FROM fact WHERE region = 'ASIA' AND month_key BETWEEN 199601 AND 199712) WHERE rn BETWEEN 101 AND 200")
def m15_table_read(spark, sf):
    rows = serving.table_filters(A.fact(spark, sf), {"region": "ASIA"}, {"month_key": (199601, 199712)})
    return serving.page(rows, [F.col("total_qty").desc(), F.col("order_key"), F.col("line_number")], 2, 100).select("order_key", "line_number", "total_qty")


# P: summaries


@query("SELECT site_code, month_key, sum(demand_qty) FILTER (WHERE snapshot_id = 'S1') AS \"S1\", sum(demand_qty) FILTER (WHERE snapshot_id = 'S2') AS \"S2\" FROM demand GROUP BY 1, 2")
def p1_snapshot_comparison(spark, sf):
    return A.demand(spark, sf).groupBy("site_code", "month_key").pivot("snapshot_id", ["S1", "S2"]).agg(F.sum("demand_qty"))


@query(f"SELECT site_code, product_family, count(DISTINCT product_number) AS products, count(DISTINCT factory_code) AS equipment, sum(total_qty) AS qty, {R('avg(yield_avg)')} AS yield_avg FROM fact GROUP BY 1, 2")
def p2_site_product_summary(spark, sf):
    out = A.fact(spark, sf).groupBy("site_code", "product_family")
    return rounded(out.agg(F.countDistinct("product_number").alias("products"), F.countDistinct("factory_code").alias("equipment"), F.sum("total_qty").alias("qty"), F.avg("yield_avg").alias("yield_avg")))


@query("SELECT month_key, CAST(month_key % 100 AS INTEGER) AS month_of_year, CASE WHEN month_key % 100 % 3 = 0 THEN 1 ELSE 0 END AS is_quarter_end FROM (SELECT unnest(list_transform(range(0, date_diff('month', lo, hi) + 1), lambda i: CAST(strftime(lo + to_months(CAST(i AS INTEGER)), '%Y%m') AS INTEGER))) AS month_key FROM (SELECT date_trunc('month', min(l_shipdate)) AS lo, date_trunc('month', max(l_shipdate)) AS hi FROM lineitem))")
def p3_calendar(spark, sf):
    ends = A.fact(spark, sf).agg(F.min("month_key").alias("lo"), F.max("month_key").alias("hi"))
    months = ends.select(F.explode(C.month_range("lo", "hi")).alias("month_key"))
    return months.withColumns({k: v for k, v in C.calendar_features("month_key", A.CUTOFF).items() if k in ("month_of_year", "is_quarter_end")})


_SEV = ", ".join(f"count(*) FILTER (WHERE bottleneck_severity = '{s}') AS {s.lower()}" for s in C.SEVERITY_SCORES)


@query(f"SELECT site_code, test_type, {_SEV} FROM cap GROUP BY 1, 2")
def p4_severity_heatmap(spark, sf):
    return PR.cells(chains.folded(spark, sf)).groupBy("site_code", "test_type").agg(*[F.sum(s).alias(s.lower()) for s in C.SEVERITY_SCORES])


@query(f"SELECT bottleneck_severity, count(*) AS n, {R('count(*) / sum(count(*)) OVER ()', 6)} AS share FROM cap GROUP BY 1")
def p5_severity_shares(spark, sf):
    each = F.array(*[F.struct(F.lit(s).alias("bottleneck_severity"), F.col(s).alias("n")) for s in C.SEVERITY_SCORES])
    counts = PR.cells(chains.folded(spark, sf)).select(F.inline(each)).groupBy("bottleneck_severity").agg(F.sum("n").alias("n")).where("n > 0")
    return rounded(counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))))  # a row per severity


# streaming


@query("SELECT user_id, event_type, date_trunc('hour', ts) AS hour, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2, 3")
def n1_telemetry_stream(spark, sf):
    rows = deduplicated_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema, ["event_id"], "ts", io.scratch(spark, "stream"))
    out = rows.groupBy("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return out
