import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planforge.functions import columns as C
from planforge.operators import capacity as K
from planforge.operators import forecast as FC
from planforge.operators import ml, quality, reshape
from planforge.operators import windows as G
from planforge.operators.analytics import daily_rollup
from planforge.operators.quantiles import middle_values


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


WORKED = dict(
    handling_time_sec=45.0, target_test_time_sec=180.0, target_yield=0.87, retest_r=2.0, retest_x=0.75, utilization_rate=0.82, hours=8.0, allowance_pct=0.10,
    productivity_pct=0.95, working_days=22.0, shifts=3.0, equip_qty_available=12, effective_demand_qty=45000.0,
)


def test_worked_capacity_example(spark):
    r = K.with_steps(one(spark, **WORKED)).first()
    assert r["step1_avg_test_time"] == pytest.approx(268.875)
    assert r["step2_total_avg_test_time"] == pytest.approx(327.8963, abs=1e-4)
    assert r["step3_productivity_adjusted"] == pytest.approx(75.0969, abs=1e-4)
    assert r["step4_monthly_shifts"] == 66
    assert r["capacity_qty"] == pytest.approx(59476.75, abs=0.01)
    assert (r["need_ceiling"], r["investment_need_units"], r["excess_capacity_units"]) == (10, 0, 2)
    assert r["gap_pct"] == pytest.approx(0.3217, abs=1e-4)
    assert r["bottleneck_severity"] == "EXCESS"


def test_capacity_without_supply_or_demand(spark):
    r = K.with_steps(one(spark, **WORKED | {"handling_time_sec": 0.0, "target_test_time_sec": 0.0})).first()
    assert r["need_fractional"] == 9999 and r["capacity_qty"] == 0 and r["utilization_pct"] == math.inf
    r = K.with_steps(one(spark, **WORKED | {"effective_demand_qty": 0.0})).first()
    assert r["gap_pct"] == 0 and r["need_ceiling"] == 0


@pytest.mark.parametrize(
    "gap,row,rollup",
    [(0.20, "EXCESS", "EXCESS"), (0.15, "BALANCED", "EXCESS"), (0.05, "LOW", "EXCESS"), (0.04, "LOW", "BALANCED"), (0.0, "LOW", "BALANCED"), (-0.03, "MEDIUM", "LOW"), (-0.05, "HIGH", "MEDIUM"), (-0.08, "HIGH", "MEDIUM"), (-0.10, "CRITICAL", "HIGH"), (-0.15, "CRITICAL", "HIGH"), (-0.20, "CRITICAL", "CRITICAL"), (None, "UNKNOWN", "EXCESS")],
)
def test_severity_scales(spark, gap, row, rollup):
    r = spark.range(1).select(F.lit(gap).cast("double").alias("g")).select(C.severity("g").alias("a"), C.severity("g", C.ROLLUP_SCALE).alias("b")).first()
    assert (r["a"], r["b"]) == (row, rollup)


def test_retest_factors(spark):
    r, x = K.retest_factors(F.col("k"))
    got = one(spark, k="TYPE2", yield_retest_1=0.8, yield_retest_2_plus=0.9, retest_quote=0.75).select(r.alias("r"), x.alias("x")).first()
    assert got["r"] == pytest.approx(1.1 / 0.9) and got["x"] == 0.75


def test_risk_tiers_are_right_closed(spark):
    got = spark.createDataFrame([(0.2,), (0.4,), (0.7,), (0.71,)], "p double").select(C.risk_tier("p")).collect()
    assert [r[0] for r in got] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def test_validation_reasons(spark):
    spec = quality.TableSpec("t", ("k",), ("y",), ("q",), "d", "2023-01-01", "2023-12-31")
    rows = [(None, 0.5, 1, "2023-02-01"), (" ", 1.2, 1, "2023-02-01"), ("a", 0.5, -3, "2022-12-31"), ("a", None, None, "x"), ("a", 1.0, 0, "2023-12-31")]
    got = quality.validate(spark.createDataFrame(rows, "k string, y double, q int, d string"), spec).collect()
    assert [r["invalid_reason"] for r in got] == ["NULL_PRIMARY_KEY:k", "NULL_PRIMARY_KEY:k; YIELD_OUT_OF_RANGE:y=1.2000", "NEGATIVE_QUANTITY:q=-3; DATE_OUT_OF_RANGE:d=2022-12-31", "INVALID_DATE:d=x", ""]
    assert [r["is_valid"] for r in got] == [False] * 4 + [True]


def test_metadata_keeps_is_valid(spark):
    df = one(spark, is_valid=False, invalid_reason="why")
    assert quality.add_metadata(df, "s", "r", F.current_timestamp()).first()["is_valid"] is False


def test_unpivot_golden(spark):
    df = spark.createDataFrame([("k", 1, 2.5, None)], "k string, jan_2023 long, feb_2023 double, mar_2023 double")
    assert [(r["month_key"], r["v"]) for r in reshape.unpivot_months(df, ["k"], "v").collect()] == [(202301, 1.0), (202302, 2.5)]
    assert reshape.unpivot_months(df, ["k"], "v", drop_nulls=False).count() == 3


def test_forward_fill_is_idempotent(spark):
    df = spark.createDataFrame([("s", 1, 5.0), ("s", 2, None), ("s", 3, 7.0), ("t", 1, None)], "k string, month_key int, y double")
    once = G.forward_fill(df, "y", G.series(["k"]))
    assert [(r["y"], r["is_forward_filled"]) for r in once.orderBy("k", "month_key").collect()] == [(5.0, False), (5.0, True), (7.0, False), (None, False)]
    again = G.forward_fill(once.drop("is_forward_filled"), "y", G.series(["k"]))
    assert again.where("is_forward_filled").count() == 0


def test_look_ahead_label(spark):
    rows = [("s", i, v) for i, v in enumerate((0.90, 0.91, 0.95, 0.87, 0.92))]
    df = spark.createDataFrame(rows, "k string, month_key int, oee double")
    got = df.withColumn("l", G.below_within("oee", 0.88, 3, G.series(["k"]))).orderBy("month_key").collect()
    assert [r["l"] for r in got] == [1, 1, 1, 0, 0]


def test_percent_rank_with_ties(spark):
    values = [float(random.Random(1).randrange(40)) for _ in range(500)]
    values = [float(random.Random(i).randrange(40)) for i in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["p"] for r in G.percent_rank_of(df, "v", "p", buckets=8).collect()}
    for i, v in enumerate(values):
        assert got[i] == pytest.approx((sum(x < v for x in values) + (values.count(v) + 1) / 2) / len(values))


def croston_loop(values, alpha=0.1):
    a = q = last = None
    for i, v in enumerate(values):
        if v > 0:
            a, q = (v, 1.0) if a is None else (alpha * v + (1 - alpha) * a, q)
            last = i
    if a is None:
        return 0.0
    at = [i for i, v in enumerate(values) if v > 0]
    mean = (at[-1] - at[0]) / (len(at) - 1) if len(at) > 1 else 1.0
    for _ in at[1:]:
        q = alpha * mean + (1 - alpha) * q
    assert last is not None
    return a / max(q, 1.0)


def test_croston_closed_form(spark):
    rng = random.Random(3)
    series = {k: [rng.choice([0, 0, rng.randint(1, 9)]) for _ in range(rng.randint(1, 30))] for k in range(60)} | {99: [0, 4, 0, 0, 6]}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], "k int, i int, v double")
    got = {r["k"]: r["croston"] for r in FC.croston(df, ["k"], "v", "i").collect()}
    assert got[99] == pytest.approx(3.5)
    assert all(got[k] == pytest.approx(croston_loop(vs)) for k, vs in series.items())


def test_middle_values(spark):
    rng = random.Random(4)
    many = [float(rng.choice([7, rng.randint(-9, 99), rng.random()])) for _ in range(3001)]
    for values in ([1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [4.0, 1.0, 3.0, 2.0], [2.0] * 5, many, many[1:]):
        got = middle_values(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v", 100).first()
        assert (got["lower_middle"], got["upper_middle"]) == (sorted(values)[(len(values) - 1) // 2], sorted(values)[len(values) // 2])
    assert middle_values(spark.createDataFrame([(None,)], "v double"), "v").first()["upper_middle"] is None


def test_daily_rollup_dedup(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 2.0)], "k string, q double, y double")
    assert daily_rollup(df, ["k"], ["q"], ["y"]).first()["q"] == 2.0
    assert daily_rollup(df, ["k"], ["q"], ["y"], dedup=True).first()["q"] == 1.0


@settings(max_examples=15, deadline=None)
@given(st.integers(190001, 209912).filter(lambda k: 1 <= k % 100 <= 12), st.integers(-30, 30))
def test_month_arithmetic(spark, key, n):
    r = spark.range(1).select(F.lit(key).alias("k")).select(C.add_months("k", n).alias("m"), C.month_of_label(C.month_label("k")).alias("back")).first()
    months = key // 100 * 12 + key % 100 - 1 + n
    assert r["m"] == months // 12 * 100 + months % 12 + 1 and r["back"] == key


def test_split_size_decides_the_partitions(spark, sf_dir):
    from planforge.sources import io

    import os

    path = f"{sf_dir.replace('sf0.001', 'sf0.1')}/lineitem.parquet"
    mb = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path)) >> 20 if os.path.isdir(path) else os.path.getsize(path) >> 20
    few, many = (io.read_splits(spark, path, split_mb=m).rdd.getNumPartitions() for m in (512, 1))
    assert few < many and many >= mb - 1


def months_of(spark, series, first=199901):
    rows = [(site, "F", C_add(first, i), float(v)) for site, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "site_code string, product_family string, month_key int, demand_qty double")


def C_add(key, n):
    m = key // 100 * 12 + key % 100 - 1 + n
    return m // 12 * 100 + m % 12 + 1


@pytest.fixture
def small_models(monkeypatch):
    """The models of plans/scores.py with few and flat trees."""
    from dataclasses import replace

    from planforge.plans import scores as SC

    for name in ("DEMAND", "DEMAND_LEAVES", "YIELD", "FAILURE"):
        monkeypatch.setattr(SC, name, replace(getattr(SC, name), trees=8, depth=3, rate=0.3))
    return SC


def test_forecasts_mix_the_trees_and_the_trend(spark, small_models):
    from planforge.operators import trend as TR

    SC, rng = small_models, random.Random(5)
    old = [50 + i + 20 * math.sin(i * math.pi / 6) + rng.random() for i in range(48)]
    months = months_of(spark, {"OLD": old, "NEW": [0, 4, 0, 0, 6]})
    tables, meta = SC.demand_tables(months)
    got = {(r["site_code"], r["horizon"]): r for r in tables["forecasts"].collect()}
    assert len(got) == 2 * SC.HORIZON and {r["month_key"] for r in got.values() if r["site_code"] == "OLD"} == {C_add(199901, 48 + i) for i in range(SC.HORIZON)}
    assert all(got["NEW", h]["method"] == "CROSTON" and got["NEW", h]["forecast"] == pytest.approx(3.5) for h in range(1, 7))
    # by hand: the features of each step from what was forecast before it
    models = SC.B.from_table(tables["trees"], meta["features"])
    trend = {r["horizon"]: r["trend_forecast"] for r in TR.changepoint_forecasts(TR.histories(months.where("site_code = 'OLD'"), SC.SITE), SC.SITE, SC.HORIZON).collect()}
    known = {"levels": list(old), "leaves": list(old)}
    for h in range(1, SC.HORIZON + 1):
        step = {}
        for name, values in known.items():
            again = months_of(spark, {"OLD": [*values, 0.0], "NEW": [0, 4, 0, 0, 6]}) if h in (1, 7) else None
            if again is not None:  # the batch features of the months so far, the forecasts among them
                features, names = SC.demand_features(again)
                row = features.where(f"site_code = 'OLD' and month_key = {C_add(199901, 47 + h)}").select(*names).toPandas().to_numpy(float)
                tail = SC.np.array([values[-12:]], float)
                direct = SC.demand_table(tail, SC.np.array([1999 * 12 + 48 + h]), row[:, -2:])
                assert SC.np.allclose(direct, row)
            x = SC.demand_table(SC.np.array([values[-12:]], float), SC.np.array([1999 * 12 + 48 + h]), SC.np.array([[1.0, 0.0]]))
            step[name] = max(float(models[name].predict(x)[0]), 0.0)
            values.append(step[name])
        assert got["OLD", h]["method"] == "ENSEMBLE"
        assert got["OLD", h]["forecast"] == pytest.approx(0.35 * trend[h] + 0.35 * step["levels"] + 0.30 * step["leaves"], abs=0.006)


def test_backtest_knows_nothing_of_the_months_it_scores(spark, small_models):
    SC = small_models
    values = [10.0 + i % 12 for i in range(36)]
    series = lambda v: {"A": v, "B": [x + 3 for x in values], "SHORT": [1.0] * 3}
    backtest = lambda v: {(r["site_code"], r["origin"], r["month_key"]): r["forecast"] for r in SC.demand_tables(months_of(spark, series(v)))[0]["backtest"].collect()}
    plain = backtest(values)
    assert sorted(plain) == sorted((s, o, C_add(199901, 36 - o + i)) for s in "AB" for o in SC.ORIGINS for i in range(SC.HOLD_OUT))
    for origin in SC.ORIGINS:
        bent = backtest(values[:-origin] + [9999.0 - i for i in range(origin)])  # every month after the origin
        assert all(bent[k] == pytest.approx(v) for k, v in plain.items() if k[1] == origin)
    score = SC.demand_accuracy(spark.createDataFrame([("A", "F", 1, 10.0, 12.0), ("A", "F", 2, 0.0, 1.0)], "site_code string, product_family string, month_key int, demand_qty double, forecast double")).first()
    assert (score["mape"], score["mae"], score["rmse"], score["n"]) == (20.0, 1.5, 1.58, 2)


def test_store_publishes_whole_versions(spark, tmp_path):
    from planforge.sources.store import Store, fingerprint

    at, one = Store(spark, f"file://{tmp_path}/store"), spark.createDataFrame([(1,)], "x int")
    assert at.current("m") is None and at.metadata("m") is None and at.versions("m") == []
    first = at.publish("m", {"t": one}, {"source": "a"})
    with pytest.raises(Exception, match="boom"):
        at.publish("m", {"t": one, "u": one.select(F.raise_error(F.lit("boom")).cast("int").alias("x"))}, {"source": "b"})
    assert at.current("m") == first and at.table("m", "t").collect() == one.collect()
    built = []
    build = lambda: (built.append(1), ({"t": one.union(one)}, {"n": 2}))[1]
    assert at.fresh("m", "a", build) == first and not built
    second = at.fresh("m", "c", build)
    assert at.fresh("m", "c", build) == second and len(built) == 1 and at.metadata("m")["n"] == 2
    assert at.table("m", "t").count() == 2 and at.table("m", "t", first).count() == 1
    at.prune("m")
    assert at.versions("m") == [second]
    path = f"file://{tmp_path}/data"
    one.write.parquet(path)
    before = fingerprint(spark, [path])
    one.write.mode("append").parquet(path)
    assert before != fingerprint(spark, [path])


def test_models_are_fitted_once_and_read(spark, sf_dir, small_models, monkeypatch):
    SC, fits = small_models, []
    fit = SC.B.fit
    monkeypatch.setattr(SC.B, "fit", lambda *a, **k: (fits.append(1), fit(*a, **k))[1])
    monkeypatch.setattr(SC.store, "of_data", lambda spark, sf, root=SC.io.scratch(spark, "store-test"): SC.store.Store(spark, root))
    scores = SC.failures(spark, sf_dir)("scores")
    assert len(fits) == 1 and scores.count() > 0 and SC.failures(spark, sf_dir)("folds").count() == SC.FOLDS and len(fits) == 1
    folds = SC.yield_fold_scores(spark, sf_dir).toPandas()
    assert sorted(folds["fold"]) == list(range(SC.FOLDS)) and (folds["mae"] < 0.5).all()
    every = SC.yields(spark, sf_dir)("scores")
    parts = SC.yield_attributions(spark, sf_dir)
    assert len(fits) == 3 and parts.count() == 10 * every.count()
    # few trees use few features, so the ten largest are all of them
    model = SC.B.from_table(SC.yields(spark, sf_dir)("trees"), SC.store.of_data(spark, sf_dir).metadata("yield")["features"])["whole"]
    mean = SC.shapley.mean_margin(model)
    both = parts.groupBy("feat_pk").agg(F.sum("contribution").alias("s")).join(every, "feat_pk").select("s", "predicted_yield").toPandas()
    used = len({f for f in model.feature.ravel() if f >= 0})
    if used <= 10:
        assert SC.np.allclose(SC.np.clip(both["s"] + mean, 0, 1), both["predicted_yield"])


def test_reads_of_model_tables(spark):
    from planforge.plans import functions as T

    risk = spark.createDataFrame([("S1", "AF", 199901, 0.9, "CRITICAL"), ("S1", "AF", 199902, 0.5, "HIGH"), ("S1", "AO", 199901, 0.1, "LOW"), ("S2", "AF", 199901, 0.75, "CRITICAL")], "site_code string, test_type string, month_key int, probability double, risk_tier string")
    assert [r["probability"] for r in T.maintenance_alerts(risk, test_type="af").collect()] == [0.9, 0.75, 0.5]
    assert [r["probability"] for r in T.maintenance_alerts(risk, site="s1", tier="high").collect()] == [0.5]
    trend = [tuple(r) for r in T.failure_risk_trend(risk).collect()]
    assert trend == [("S1", 199901, 0.5, 0.9, 1), ("S1", 199902, 0.5, 0.5, 1), ("S2", 199901, 0.75, 0.75, 1)]
    parts = spark.createDataFrame([(1, "a", 2.0), (1, "b", -1.0), (2, "a", -4.0), (3, "a", 100.0)], "k int, feature string, contribution double")
    rows = spark.createDataFrame([(1, "S1", "AF"), (2, "S1", "AF"), (3, "S2", "AF")], "k int, site_code string, test_type string")
    assert [tuple(r) for r in T.yield_drivers(parts, rows, "k", site="s1").collect()] == [("a", 3.0, -1.0, 2), ("b", 1.0, -1.0, 1)]
    ahead = spark.createDataFrame([("S1", "F", 200001, 1.0, "CROSTON"), ("S1", "G", 200001, 2.0, "ENSEMBLE")], "site_code string, product_family string, month_key int, forecast double, method string")
    assert [r["product_family"] for r in T.demand_forecast(ahead, method="croston").collect()] == ["F"]
    errors = spark.createDataFrame([("S1", "F", 5.0), ("S1", "G", None), ("S2", "F", 1.0), ("S1", "H", 2.0)], "site_code string, product_family string, mape double")
    assert [r["product_family"] for r in T.forecast_accuracy(errors, site="s1").collect()] == ["H", "F", "G"]
    both = T.accuracy_summary(errors).first()
    assert (both["median_error"], both["upper_median_error"]) == (2.0, 2.0)


def test_exact_quantiles_of_counts(spark):
    from planforge.operators.quantiles import exact_quantiles

    rng = random.Random(9)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [5.0] * 50 + [7.0] * 3, "nulls": [None, 4.0, None], "none": [None], "many": [rng.choice([rng.random(), 0.5]) for _ in range(400)]}
    rows = [(k, v, None if v is None else -v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(5)
    shares = {"m": ("a", 0.5), "p80": ("a", 0.8), "low": ("b", 0.0), "top": ("b", 1.0)}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], shares).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        kept = [v for v in vs if v is not None]
        for name, (c, share) in shares.items():
            want = None
            if kept:
                ordered = sorted(kept if c == "a" else [-v for v in kept])
                at = share * (len(ordered) - 1)
                want = ordered[math.floor(at)] + (ordered[math.ceil(at)] - ordered[math.floor(at)]) * (at - math.floor(at))
            assert got[k][name] == pytest.approx(want) if want is not None else got[k][name] is None


def test_beta_levels_are_the_inverse_distribution(spark):
    from planforge.operators import risk as RK

    fits = spark.createDataFrame([("U", 1.0, 1.0), ("S", 2.0, 1.0), ("H", 40.0, 4.0), ("B", 0.5, 0.5)], "t string, alpha double, beta double")
    rows = RK.beta_levels(fits, ["t"]).collect()
    by = {t: [r["y"] for r in sorted((r for r in rows if r["t"] == t), key=lambda r: r["k"])] for t in "USHB"}
    assert all(len(v) == RK.LEVELS and v == sorted(v) for v in by.values())
    for k in range(0, RK.LEVELS, 37):
        u = (k + 0.5) / RK.LEVELS
        assert by["U"][k] == pytest.approx(u, abs=2 / RK.CELLS) and by["S"][k] == pytest.approx(u**0.5, abs=2 / RK.CELLS)
        assert by["B"][k] == pytest.approx(math.sin(math.pi * u / 2) ** 2, abs=0.02)
    mean = sum(by["H"]) / RK.LEVELS
    assert mean == pytest.approx(40 / 44, abs=1e-3)
    assert sum((y - mean) ** 2 for y in by["H"]) / RK.LEVELS == pytest.approx(40 * 4 / (44**2 * 45), rel=0.02)


def test_draws_follow_the_steps(spark):
    """Each draw by hand; no spread gives the need of the capacity steps."""
    from planforge.operators import risk as RK

    row = ("S", "AF", 7, 10.0, 50.0, 0.9, 8.0, 20.0, 2.0, 0.1, 0.95, 900.0, 0.0, 0.8, 0.8, 0.8)
    names = "site_code string, test_type string, combo_no long, handling_time_sec double, target_test_time_sec double, target_yield double, hours double, working_days double, shifts double, allowance double, productivity double, demand_mean double, demand_cv double, low double, mode double, high double"
    combos = spark.createDataFrame([row], names)
    step1 = 60.0 * (1 + 0.1 * 2 * 0.75)
    supply = 8.0 * 3600 * 0.9 * 0.95 / (step1 / 0.8) * 40
    assert {r["need"] for r in RK.monte_carlo_need(combos, 20).collect()} == {math.ceil(900 / supply)}
    levels = RK.beta_levels(spark.createDataFrame([("AF", 5.0, 1.0)], "test_type string, alpha double, beta double"), ["test_type"])
    wide = combos.withColumns({"demand_cv": F.lit(0.5), "demand_mean": F.lit(90000.0), "low": F.lit(0.5)})
    fixed, sampled = (RK.monte_carlo_need(wide, 4000, lv).agg(F.avg("need").alias("m"), F.count_distinct("need").alias("d")).first() for lv in (None, levels))
    assert fixed["d"] > 5 and sampled["m"] > fixed["m"]  # the mean of Beta(5, 1) is 0.83
    sizes = RK.size_summary(RK.need_counts(RK.monte_carlo_need(wide, 4000), ["site_code", "test_type"]), ["site_code", "test_type"])
    spent = RK.investment(sizes, spark.createDataFrame([("S", "AF", 1.0)], "site_code string, test_type string, current_equipment_qty double"), ["site_code", "test_type"], F.lit(100.0)).first()
    assert spent["delta_units_p80"] == max(spent["p80_need"] - 1, 0) and spent["capex_usd_p80"] == round(spent["delta_units_p80"] * 100)
