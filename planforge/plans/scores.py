"""What the models give: the tables that forecasts, alerts, drivers and reads start from.

Models are fitted once for the state of the tables they come from; their trees, scores and metadata are
published in a store (sources/store.py), and every read takes them from there. Features look back only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planforge.functions import columns as C
from planforge.operators import analytics as N
from planforge.operators import boosting as B
from planforge.operators import forecast as FC
from planforge.operators import ml, shapley
from planforge.operators import trend as TR
from planforge.operators import windows as G
from planforge.plans import adapters as A
from planforge.plans.adapters import SERIES
from planforge.sources import io, store

#: Sizes and rates of the boosted models, level-wise and leaf-wise.
DEMAND = B.Params(trees=300, rate=0.05, depth=6, rows=0.8, columns=0.8, child_weight=3, l1=0.1, l2=1.0, seed=42)
DEMAND_LEAVES = replace(DEMAND, leaves=63, child_weight=5, seed=43)
YIELD = B.Params(trees=400, rate=0.04, depth=7, rows=0.8, columns=0.7, child_weight=5, l1=0.05, l2=1.5, seed=42)
FAILURE = B.Params(trees=300, rate=0.05, depth=5, rows=0.8, columns=0.8, child_weight=3, l1=0.0, l2=1.0, positive_weight=5, seed=42)
SITE = ["site_code", "product_family"]
MACHINE = ["site_code", "test_type"]
HOLD_OUT, HORIZON, NPI_MONTHS, LEAST_ROWS = 6, 18, 12, 6
ORIGINS = (6, 12)
FOLDS = 5
FAILING_OEE, AHEAD = 0.88, 3


def site_months(spark: SparkSession, sf: str) -> DataFrame:
    """Demand of each site and family by month."""
    return A.fact(spark, sf).groupBy(*SITE, "month_key").agg(F.sum("total_qty").alias("demand_qty"))


def oee_months(spark: SparkSession, sf: str) -> DataFrame:
    return N.oee(A.daily(spark, sf), [*MACHINE, "month_key"])


def looking_back(columns: dict[str, str], steps: list[int], sizes: list[int], w: WindowSpec) -> dict[str, Column]:
    """Lags, and means and deviations over the rows before the present one; columns: name -> prefix."""
    out = {}
    for c, prefix in columns.items():
        out |= G.lags(c, steps, w, prefix)
        for n in sizes:
            before = w.rowsBetween(-n, -1)
            out |= {f"{prefix}_before_avg_{n}": F.avg(c).over(before), f"{prefix}_before_std_{n}": F.coalesce(F.stddev_samp(c).over(before), F.lit(0.0))}
    return out


def calendar(month: str = "month_key") -> dict[str, Column]:
    moy = F.col(month) % 100
    return {"month_number": C.month_number(month), "month_of_year": moy, "year": F.floor(F.col(month) / 100), "quarter_of_year": F.ceil(moy / 3)}


def _written(df: DataFrame, name: str) -> DataFrame:
    """Rows that several fits and scores read."""
    return io.overwrite(df, io.scratch(df.sparkSession, name))


def _modelled(df: DataFrame, new: dict[str, Column], codes: list[str], more: list[str], name: str) -> tuple[DataFrame, list[str]]:
    """df with its features as numbers, written, and their names."""
    names = [*new, *calendar(), *[f"{c}_code" for c in codes], *more]
    rows = ml.category_codes(_written(df.withColumns(new | calendar()), name), codes)
    return _written(rows.withColumns({c: B.number(c) for c in names}), f"{name}-coded"), names


def _described(params: dict[str, B.Params], names: list[str], **more) -> dict:
    return {"features": names, "params": {k: asdict(p) for k, p in params.items()}} | more


#: Part of what an entry is built from: raised when a change here or in the operators changes what is stored.
VERSION = 1


def stored(spark: SparkSession, sf: str, name: str, settings: tuple, build: Callable[[], tuple[dict[str, DataFrame], dict]]) -> Callable[[str], DataFrame]:
    """Reads tables of an entry, which is built first where there is none of the present tables with the same settings."""
    at = store.of_data(spark, sf)
    files = store.fingerprint(spark, [f"{sf}/{t}.parquet" for t in ("lineitem", "orders", "part", "supplier", "customer", "nation", "region", "events")])
    version = at.fresh(name, f"{VERSION} {settings!r} {files}", build)
    return lambda table: at.table(name, table, version)


# demand


DEMAND_LAGS, DEMAND_SIZES = [1, 2, 3, 6, 12], [3, 6, 12]


def demand_features(months: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with features, how many months of the series come after (``after``) and how many it has."""
    new = looking_back({"demand_qty": "demand"}, DEMAND_LAGS, DEMAND_SIZES, G.series(SITE))
    after = F.row_number().over(W.partitionBy(*SITE).orderBy(F.col("month_key").desc())) - 1
    return _modelled(months.withColumns({"after": after, "n_months": F.count("*").over(W.partitionBy(*SITE))}), new, SITE, [], "demand-features")


def _demand_uses(rows: DataFrame) -> DataFrame:
    """For each origin the rows before it; a series of no more rows than the origin goes back trains with all."""
    return rows.withColumns({f"before_{o}": (F.col("after") >= o) | (F.col("n_months") <= o) for o in ORIGINS} | {"whole": F.lit(True)})


def demand_models(rows: DataFrame, names: list[str]) -> dict[str, B.Ensemble]:
    """Level-wise and leaf-wise trees for each origin of the backtest and for all rows, fitted side by side."""
    uses = {f"_{o}": f"before_{o}" for o in ORIGINS} | {"": "whole"}
    models = {f"{kind}{at}": (use, p) for at, use in uses.items() for kind, p in (("levels", DEMAND), ("leaves", DEMAND_LEAVES))}
    return B.fit(_demand_uses(rows), [*SITE, "month_key"], names, "demand_qty", models)


def demand_table(values: np.ndarray, ahead: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Features of the month after padded values [series, 12] (NaN in front): the columns of ``demand_features`` in their order."""
    lag = np.stack([values[:, -k] for k in DEMAND_LAGS], axis=1)
    rolling = []
    for n in DEMAND_SIZES:
        last = values[:, -n:]
        count = (~np.isnan(last)).sum(axis=1)
        mean = np.nansum(last, axis=1) / np.maximum(count, 1)
        spread = np.sqrt(np.nansum((last - mean[:, None]) ** 2, axis=1) / np.maximum(count - 1, 1))
        rolling += [mean, spread]
    month = (ahead - 1) % 12 + 1
    calendar = [ahead, month, (ahead - 1) // 12, np.ceil(month / 3)]
    return np.nan_to_num(np.column_stack([lag, *rolling, *calendar, codes]).astype(float))


def recursive_forecasts(rows: DataFrame, ensembles: dict[str, B.Ensemble], horizon: int) -> DataFrame:
    """SITE, month_key, horizon and a column per ensemble: each step's lags come from the steps before.

    rows: histories with codes. Every ensemble goes its own way, never below 0; nothing after the end
    of a history is read. Series are stepped forward together, an Arrow batch at a time.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ensembles)  # trees of parameters' size
    names = list(ensembles)
    codes = [f"{c}_code" for c in SITE]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            most = max(*DEMAND_LAGS, *DEMAND_SIZES)
            tail = np.full((len(pdf), most), np.nan)
            for i, v in enumerate(pdf["values"]):
                tail[i, most - min(most, len(v)) :] = v[-most:]
            last, code = np.array([m[-1] for m in pdf["months"]]), pdf[codes].to_numpy(float)
            got = {}
            for name, e in shared.value.items():
                values, steps = tail.copy(), []
                for h in range(1, horizon + 1):
                    step = np.maximum(e.predict(demand_table(values, last + h, code)), 0.0)
                    values = np.column_stack([values[:, 1:], step])
                    steps.append(step)
                got[name] = np.column_stack(steps).ravel()
            ahead = last[:, None] + np.arange(1, horizon + 1)
            frame = {c: np.repeat(pdf[c].to_numpy(), horizon) for c in SITE}
            yield pd.DataFrame(frame | {"month_key": TR.month_key_of(ahead).ravel().astype(np.int32), "horizon": np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(pdf))} | got)

    schema = ", ".join([*[f"{c} string" for c in SITE], "month_key int", "horizon int", *[f"`{n}` double" for n in names]])
    return rows.select(*SITE, *codes, "months", "values").mapInPandas(run, schema)


def _mixed(rows: DataFrame, levels: B.Ensemble, leaves: B.Ensemble, horizon: int) -> DataFrame:
    """The parts of the ensemble side by side: levels, leaves, trend_forecast."""
    trees = recursive_forecasts(rows, {"levels": levels, "leaves": leaves}, horizon)
    return trees.join(TR.changepoint_forecasts(rows, SITE, horizon), [*SITE, "month_key", "horizon"])


def _with_codes(features: DataFrame) -> DataFrame:
    codes = features.groupBy(*SITE).agg(*[F.max(f"{c}_code").alias(f"{c}_code") for c in SITE])
    return TR.histories(features, SITE).join(codes, SITE)


def demand_forecasts(features: DataFrame, models: dict[str, B.Ensemble], horizon: int = HORIZON) -> DataFrame:
    """site_code, product_family, month_key, horizon, forecast, method.

    0.35 of the trend, 0.35 of the level-wise and 0.30 of the leaf-wise trees, which are fitted on
    all rows and fed with their own forecasts; Croston's forecast for series of fewer than NPI_MONTHS months.
    """
    rows = _with_codes(features)
    rare = FC.croston(features.select(*SITE, C.month_number("month_key").alias("at"), "demand_qty"), SITE, "demand_qty", "at")
    out = _mixed(rows, models["levels"], models["leaves"], horizon).join(rare, SITE).join(rows.select(*SITE, F.size("months").alias("n_months")), SITE)
    forecast, method = FC.ensemble(F.col("trend_forecast"), F.col("levels"), F.col("leaves"), F.col("croston"), F.col("n_months") < max(NPI_MONTHS, LEAST_ROWS))
    return out.select(*SITE, "month_key", "horizon", F.round(forecast, 2).alias("forecast"), method.alias("method"))


def demand_backtest(features: DataFrame, models: dict[str, B.Ensemble]) -> DataFrame:
    """SITE, origin, month_key, horizon, demand_qty, forecast: HOLD_OUT months from each origin by the path that is served.

    An origin is so many rows before the end of a series of more rows; its models, trend and lags
    know only what was before it. Months that the table lacks are not scored.
    """
    rows, out = _with_codes(features), []
    for o in ORIGINS:
        mixed = _mixed(TR.without_last(rows, o), models[f"levels_{o}"], models[f"leaves_{o}"], HOLD_OUT)
        forecast, _ = FC.ensemble(F.col("trend_forecast"), F.col("levels"), F.col("leaves"), F.lit(0.0), F.lit(False))
        out.append(mixed.select(*SITE, F.lit(o).alias("origin"), "month_key", "horizon", forecast.alias("forecast")))
    ahead = out[0]
    for more in out[1:]:
        ahead = ahead.unionByName(more)
    return features.select(*SITE, "month_key", "demand_qty").join(ahead, [*SITE, "month_key"]).select(*SITE, "origin", "month_key", "horizon", "demand_qty", "forecast")


def demand_accuracy(backtest: DataFrame) -> DataFrame:
    out = backtest.groupBy(*SITE).agg(*FC.error_metrics(F.col("demand_qty"), F.col("forecast")))
    return out.withColumns({c: F.round(c, 2) for c in ("mape", "smape", "rmse", "mae")})


def demand_tables(months: DataFrame) -> tuple[dict[str, DataFrame], dict]:
    features, names = demand_features(months)
    models = demand_models(features, names)
    fitted = B.scored(features, {k: models[f"{k}_{HOLD_OUT}"] for k in ("levels", "leaves")}, names)
    fitted = fitted.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in ("levels", "leaves")})
    is_test = (F.col("after") < HOLD_OUT) & (F.col("n_months") > HOLD_OUT)
    tables = {
        "features": features, "trees": B.as_table(months.sparkSession, models, names), "fitted": fitted.select(*SITE, "month_key", "demand_qty", is_test.alias("is_test"), "levels", "leaves"),
        "forecasts": demand_forecasts(features, models), "backtest": demand_backtest(features, models),
    }
    return tables, _described({"levels": DEMAND, "leaves": DEMAND_LEAVES}, names, target="demand_qty")


def demand(spark: SparkSession, sf: str) -> Callable[[str], DataFrame]:
    """fitted, forecasts, backtest, features and trees."""
    return stored(spark, sf, "demand", (DEMAND, DEMAND_LEAVES, ORIGINS, HOLD_OUT, HORIZON), lambda: demand_tables(site_months(spark, sf)))


# yield


def yield_features(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    oee = oee_months(spark, sf).select(*MACHINE, "month_key", "oee")
    rows = A.monthly(spark, sf).join(oee, [*MACHINE, "month_key"], "left").withColumn("feat_pk", C.md5_strict(*SERIES, "month_key"))
    new = looking_back({"target_yield": "yield", "oee": "oee", "demand_qty": "demand"}, [1, 2, 3, 6, 12], [3, 6, 12], G.series(SERIES))
    return _modelled(rows.where("target_yield is not null"), new, SERIES, ["target_test_time_sec", "utilization_rate"], "yield-features")


def yield_tables(rows: DataFrame, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    """Features and scores by the model of all rows."""
    model = B.fit(rows.withColumn("whole", F.lit(True)), ["feat_pk"], names, "target_yield", {"whole": ("whole", YIELD)})
    scored = B.scored(rows, {"predicted_yield": model["whole"]}, names).withColumn("predicted_yield", C.clip(F.col("predicted_yield"), 0.0, 1.0))
    scored = scored.withColumns(ml.residuals(F.col("target_yield"), F.col("predicted_yield")))
    return {"scores": scored, "trees": B.as_table(rows.sparkSession, model, names)}, _described({"whole": YIELD}, names, target="target_yield")


def yield_folds(rows: DataFrame, names: list[str]) -> DataFrame:
    """fold, mae, r2, n of FOLDS models that know only the months before their fold, fitted side by side."""
    months = [r["month_key"] for r in rows.select("month_key").distinct().orderBy("month_key").collect()]  # months of the table
    cuts = [months[len(months) * i // (FOLDS + 1)] for i in range(1, FOLDS + 1)]
    uses = {f"fold_{i}": F.col("month_key") < cuts[i] for i in range(FOLDS)}
    models = B.fit(rows.withColumns(uses), ["feat_pk"], names, "target_yield", {u: (u, YIELD) for u in uses})
    fold = F.array_size(F.filter(F.lit(cuts), lambda c: c <= F.col("month_key")))  # from 1
    scored = B.scored(rows.where(F.col("month_key") >= cuts[0]), models, names).withColumn("fold", fold - 1)
    unseen = C.clip(F.element_at(F.array(*[F.col(u) for u in uses]), fold), 0.0, 1.0)
    scored = scored.withColumn("error", unseen - F.col("target_yield"))
    spread = F.sum("target_yield") * F.avg("target_yield")
    r2 = 1 - F.try_divide(F.sum(F.col("error") ** 2), F.sum(F.col("target_yield") ** 2) - spread)
    return scored.groupBy("fold").agg(F.avg(F.abs("error")).alias("mae"), r2.alias("r2"), F.count("*").alias("n"))


def yield_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Features of the yield model and of its folds, which need no fit of each other."""

    def build() -> tuple[dict[str, DataFrame], dict]:
        rows, names = yield_features(spark, sf)
        return {"rows": rows}, {"features": names}

    return stored(spark, sf, "yield-features", (), build)("rows"), store.of_data(spark, sf).metadata("yield-features")["features"]


def yields(spark: SparkSession, sf: str) -> Callable[[str], DataFrame]:
    """scores and trees."""
    return stored(spark, sf, "yield", (YIELD,), lambda: yield_tables(*yield_rows(spark, sf)))


def yield_fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> tuple[dict[str, DataFrame], dict]:
        rows, names = yield_rows(spark, sf)
        return {"folds": yield_folds(rows, names)}, {"features": names}

    return stored(spark, sf, "yield-folds", (YIELD, FOLDS), build)("folds")


def yield_attributions(spark: SparkSession, sf: str) -> DataFrame:
    """feat_pk, feature, contribution, rank: the ten largest Shapley values of each prediction."""

    def build() -> tuple[dict[str, DataFrame], dict]:
        read = yields(spark, sf)
        names = store.of_data(spark, sf).metadata("yield")["features"]
        model = B.from_table(read("trees"), names)["whole"]
        scores = read("scores")
        return {"attributions": shapley.attributions(scores.repartition(shapley.tasks_for(scores.count(), spark.sparkContext.defaultParallelism)), model, "feat_pk", names, 10)}, {"features": names}

    return stored(spark, sf, "yield-attributions", (YIELD,), build)("attributions")


# failure


def failure_features(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    w = G.series(MACHINE)
    o = oee_months(spark, sf)
    new = looking_back({"oee": "oee", "availability": "availability", "quality": "quality"}, [1, 2, 3, 6], [3, 6], w)
    new |= {"oee_trend_3": G.trend("oee", 3, w), "oee_roll_avg_3": F.avg("oee").over(w.rowsBetween(-2, 0))}
    rows, names = _modelled(o.withColumn("label", G.below_within("oee", FAILING_OEE, AHEAD, w)), new, MACHINE, [], "failure-features")
    return ml.stratified_folds(rows, "label", [*MACHINE, "month_key"], FOLDS), names


def failure_tables(rows: DataFrame, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    """Scores by the model of all rows, and ranking scores of FOLDS stratified models on rows they have not seen."""
    spark = rows.sparkSession
    uses = {f"fold_{i}": F.col("fold") != i for i in range(FOLDS)} | {"whole": F.lit(True)}
    models = B.fit(rows.withColumns(uses), [*MACHINE, "month_key"], names, "label", {u: (u, FAILURE) for u in uses}, logistic=True)
    scored = _written(B.scored(rows, models, names), "failure-scores")
    p = F.round("whole", 6)
    scores = scored.select(*MACHINE, "month_key", "label", p.alias("probability")).withColumn("risk_tier", C.risk_tier("probability"))
    unseen = scored.withColumn("p", F.element_at(F.array(*[F.col(f"fold_{i}") for i in range(FOLDS)]), (F.col("fold") + 1).cast("int")))
    folds = []
    for i in range(FOLDS):
        part = unseen.where(F.col("fold") == i)
        got = ml.classifier_scores(part, "p")
        folds.append((i, got["areaUnderPR"], got["areaUnderROC"], part.agg(F.avg("label")).first()[0]))
    tables = {"scores": scores, "folds": spark.createDataFrame(folds, "fold int, auc_pr double, auc_roc double, positive_rate double"), "trees": B.as_table(spark, {"whole": models["whole"]}, names)}
    return tables, _described({"whole": FAILURE}, names, target="label")


def failures(spark: SparkSession, sf: str) -> Callable[[str], DataFrame]:
    """scores, folds and trees."""
    return stored(spark, sf, "failure", (FAILURE, FOLDS, FAILING_OEE, AHEAD), lambda: failure_tables(*failure_features(spark, sf)))


# anomalies


def anomaly_scores(spark: SparkSession, sf: str, trees: int = 200) -> DataFrame:
    """site_code, test_type, month_key, oee, score (lower: odder), is_anomaly, pct, severity, from the store."""
    return stored(spark, sf, "anomaly", (trees,), lambda: ({"scores": _anomaly_scores(spark, sf, trees)}, {"trees": trees}))("scores")


def _anomaly_scores(spark: SparkSession, sf: str, trees: int) -> DataFrame:
    new = looking_back({"oee": "oee"}, [1, 2, 3], [3, 6], G.series(MACHINE))
    rows = oee_months(spark, sf).withColumns(new).withColumn("row_pk", C.md5_strict(*MACHINE, "month_key"))
    rows = _written(rows, "anomaly-features")
    names = ["availability", "performance", "quality", "oee", *new]
    z = ml.standardized(rows.na.fill(0.0, names), names)
    scored = _written(ml.isolation_forest(z, "row_pk", [f"{c}_z" for c in names], trees=trees), "anomaly-scores")
    ranked = G.percent_rank_of(scored.withColumn("score", F.round("score", 6)), "score", "pct")
    return rows.select("row_pk", *MACHINE, "month_key", "oee").join(ranked.withColumn("severity", C.anomaly_tier("pct")), "row_pk").drop("row_pk")
