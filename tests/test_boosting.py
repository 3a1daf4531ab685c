"""Boosted trees, their attributions and trends against plain versions."""

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planforge.operators import boosting as B
from planforge.operators import shapley as S
from planforge.operators import trend as T


def soft(g, l1):
    return math.copysign(max(abs(g) - l1, 0), g)


def plain_tree(x, g, h, columns, edges, p):
    """Greedy growth over all thresholds, row by row; nodes as {number: (feature, threshold, value)}."""
    tree, gains, todo = {}, {}, [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        gs, hs = g[rows].sum(), h[rows].sum()
        tree[node] = (-1, 0.0, -soft(gs, p.l1) / (hs + p.l2) * p.rate)
        best = (1e-9, None)
        for f in columns if depth < p.depth else []:
            for t in edges[f]:
                left = x[rows, f] <= t
                gl, hl = g[rows[left]].sum(), h[rows[left]].sum()
                if hl < p.child_weight or hs - hl < p.child_weight:
                    continue
                gain = soft(gl, p.l1) ** 2 / (hl + p.l2) + soft(gs - gl, p.l1) ** 2 / (hs - hl + p.l2) - soft(gs, p.l1) ** 2 / (hs + p.l2)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, t, left))
        if best[1]:
            f, t, left = best[1]
            gains[node] = (best[0], f, t)
            todo += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
    chosen, front = set(), [0] if 0 in gains else []
    while front and (not p.leaves or len(chosen) < p.leaves - 1):
        node = max(front, key=lambda n: (gains[n][0], -n))
        front.remove(node)
        chosen.add(node)
        front += [c for c in (2 * node + 1, 2 * node + 2) if c in gains]
    for node in chosen:
        tree[node] = (gains[node][1], gains[node][2], 0.0)
    return tree


def plain_score(tree, row):
    node = 0
    while tree[node][0] >= 0:
        node = 2 * node + 1 + (row[tree[node][0]] > tree[node][1])
    return tree[node][2]


def small_table(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    y = np.where(x[:, 0] > 0, 3.0, 1.0) + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.1
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, z=(y > 2).astype(float), id=range(n), train=np.arange(n) % 4 > 0, all=True)
    return x, pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("label,logistic,leaves", [("y", False, 0), ("y", False, 5), ("z", True, 6)])
def test_boosting_equals_a_plain_version(spark, label, logistic, leaves):
    x, pdf, df = small_table(spark)
    p = B.Params(trees=6, rate=0.3, depth=3, leaves=leaves, rows=1.0, columns=1.0, child_weight=2.0, l1=0.05, l2=0.7, positive_weight=3.0)
    got = B.fit(df, ["id"], list("abcd"), label, {"part": ("train", p), "whole": ("all", p)}, logistic, bins=128, block_rows=50)
    edges = B.bin_edges(df, list("abcd"), 128)
    for name, use in (("part", "train"), ("whole", "all")):
        used, y = pdf[use].to_numpy(), pdf[label].to_numpy()
        mean = y[used].mean()
        margin = np.full(len(x), math.log(mean / (1 - mean)) if logistic else mean)
        for _ in range(p.trees):
            q = 1 / (1 + np.exp(-margin))
            w = np.where(y > 0, p.positive_weight, 1.0)
            g, h = ((q - y) * w, q * (1 - q) * w) if logistic else (margin - y, np.ones(len(y)))
            tree = plain_tree(x[used], g[used], h[used], range(4), edges, p)
            margin += [plain_score(tree, row) for row in x]
        assert np.allclose(got[name].margin(x), margin, atol=1e-6)
    scored = B.scored(df, got, list("abcd")).orderBy("id").toPandas()
    assert np.allclose(scored["whole"], got["whole"].predict(x))
    again = B.from_table(B.as_table(spark, got, list("abcd")), list("abcd"))
    assert np.array_equal(again["part"].predict(x), got["part"].predict(x))


def test_boosting_on_any_partitions_and_with_samples(spark):
    x, pdf, df = small_table(spark, 3000)
    p = B.Params(trees=12, rate=0.3, depth=4, rows=0.7, columns=0.75)
    one, many = (B.fit(d, ["id"], list("abcd"), "y", {"m": ("train", p)}, block_rows=n, cut_every=5)["m"] for d, n in ((df, 10**6), (df.repartition(7), 600)))
    assert np.array_equal(one.feature, many.feature) and np.array_equal(one.value, many.value)
    held = ~pdf["train"].to_numpy()
    assert 1 - ((one.predict(x) - pdf["y"])[held] ** 2).mean() / pdf["y"].var() > 0.9
    assert len({tuple(np.unique(f[f >= 0])) for f in one.feature}) > 1  # trees see different columns


def test_boosting_without_rows_or_spread(spark):
    _, _, df = small_table(spark, 40)
    got = B.fit(df.withColumn("none", F.lit(False)).withColumn("one", F.lit(1.0)), ["id"], ["one"], "y", {"e": ("none", B.Params(trees=2)), "c": ("all", B.Params(trees=2, rows=1.0))})
    assert got["e"].predict(np.ones((3, 1))).tolist() == [0.0] * 3
    assert np.allclose(got["c"].predict(np.ones((3, 1))), df.agg(F.avg("y")).first()[0], atol=1e-6)


def subset_value(e, row, known, tree, node=0):
    """Expectation of a tree when only some features are known, by cover."""
    f = e.feature[tree, node]
    if f < 0:
        return e.value[tree, node]
    a, b = 2 * node + 1, 2 * node + 2
    if f in known:
        return subset_value(e, row, known, tree, a if row[f] <= e.threshold[tree, node] else b)
    return sum(e.cover[tree, c] / e.cover[tree, node] * subset_value(e, row, known, tree, c) for c in (a, b))


def test_shapley_values_equal_all_subsets(spark):
    x, _, df = small_table(spark)
    p = B.Params(trees=5, rate=0.5, depth=4, rows=1.0, columns=1.0, child_weight=2.0)
    e = B.fit(df, ["id"], list("abcd"), "y", {"m": ("all", p)})["m"]
    got = S.shapley_values(x, S.leaf_tables(e), chunk=64)
    assert np.allclose(got.sum(axis=1), e.margin(x) - S.mean_margin(e))
    assert S.mean_margin(e) == pytest.approx(e.margin(x).mean())  # all rows were trained on
    for i in range(0, 240, 29):
        for u in range(4):
            want = 0.0
            others = [v for v in range(4) if v != u]
            for k in range(4):
                for s in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                    want += w * sum(subset_value(e, x[i], {*s, u}, t) - subset_value(e, x[i], set(s), t) for t in range(5))
            assert got[i, u] == pytest.approx(want, abs=1e-9)
    top = S.attributions(df.withColumn("b", F.when(F.col("id") == 7, None).otherwise(F.col("b"))), e, "id", list("abcd"), 2).toPandas()
    assert len(top) == 480 and set(top["rank"]) == {1, 2}
    row = top[top["id"] == 11].sort_values("rank")
    best = np.argsort(-np.abs(got[11]))[:2]
    assert row["feature"].tolist() == [list("abcd")[j] for j in best] and np.allclose(row["contribution"], got[11][best])


def C_add(key, n):
    m = key // 100 * 12 + key % 100 - 1 + n
    return m // 12 * 100 + m % 12 + 1


def months_of(spark, series, first=199901):
    rows = [(k, C_add(first, i), float(v)) for k, values in series.items() for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "k string, month_key int, demand_qty double")


def test_trend_finds_breaks_and_seasons(spark):
    rng = np.random.default_rng(3)
    t = np.arange(72)
    season = 1 + 0.3 * np.sin(2 * np.pi * (t % 12) / 12)
    bent = np.where(t < 30, 100 + 2 * t, 160 - 1.5 * (t - 30)) * season + rng.normal(size=72)
    gaps = [None if i in (5, 17) else v for i, v in enumerate(bent[:60])]
    series = {"bent": bent[:60], "gaps": gaps, "short": [4.0, 8.0, 6.0], "zeros": [0.0] * 30, "flat": [5.0] * 24, "one": [7.0], "idle": [*bent[:40], *[0.0] * 3]}
    rows = T.histories(months_of(spark, series).repartition(3), ["k"])
    got = T.changepoint_forecasts(rows, ["k"], 12).toPandas()
    by = {k: g.sort_values("horizon") for k, g in got.groupby("k")}
    assert set(by) == set(series) and all(len(g) == 12 for g in by.values())
    assert by["bent"]["month_key"].tolist() == [C_add(199901, 60 + i) for i in range(12)]
    error = lambda k: np.abs(by[k]["trend_forecast"].to_numpy() / bent[60:] - 1).mean()
    assert error("bent") < 0.08 and error("gaps") < 0.1
    line = np.polyfit(t[:60], bent[:60], 1)
    straight = np.abs(np.polyval(line, t[60:]) * season[60:] / bent[60:] - 1).mean()
    assert error("bent") < straight / 2
    assert by["short"]["trend_forecast"].tolist() == [6.0] * 12 and by["one"]["trend_forecast"].tolist() == [7.0] * 12
    assert by["zeros"]["trend_forecast"].tolist() == [0.0] * 12
    assert np.allclose(by["flat"]["trend_forecast"], 5.0, rtol=0.02)
    assert by["idle"]["month_key"].tolist()[0] == C_add(199901, 43)
    assert T.without_last(rows, 3).count() == 5


def test_coordinate_descent_meets_its_conditions():
    rng = np.random.default_rng(4)
    d = rng.normal(size=(3, 40, 6))
    y = rng.normal(size=(3, 40)) + d[..., 0] * 2
    gram, moment = np.einsum("snk,snl->skl", d, d), np.einsum("snk,sn->sk", d, y)
    l1, l2 = np.full((3, 6), 8.0), np.full((3, 6), 0.5)
    beta = T._coordinate_descent(gram, moment, np.zeros((3, 6)), l1, l2, 200)
    slope = np.einsum("skl,sl->sk", gram, beta) - moment + l2 * beta
    assert np.allclose(slope[beta != 0], -8.0 * np.sign(beta[beta != 0]), atol=1e-6)
    assert (np.abs(slope[beta == 0]) <= 8.0 + 1e-9).all() and (beta == 0).any()


def test_the_driver_gets_splits_and_no_histograms(spark, monkeypatch):
    """What comes to the driver is far smaller than a histogram a level, and the trees are the same on one block and on many."""
    from pyspark import RDD

    df, columns = spark.range(4000).select("id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double").alias(f"c{i}") for i in range(4)]), [f"c{i}" for i in range(4)]
    df = df.withColumns({"y": F.col("c0") * F.col("c1") / 1000 + F.col("c2"), "all": F.lit(True)})
    p = B.Params(trees=3, depth=4, rows=1.0, columns=1.0)
    sent, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: sent.append(collect(self)) or sent[-1])
    monkeypatch.setattr(RDD, "treeReduce", None)
    many = B.fit(df, ["id"], columns, "y", {"m": ("all", p)}, block_rows=200)["m"]
    levels = [x for x in sent if x and isinstance(x[0], tuple)]
    assert len(levels) == 12 and not any(isinstance(v, np.ndarray) for x in levels for row in x for v in row)
    one = B.fit(df, ["id"], columns, "y", {"m": ("all", p)}, block_rows=10_000)["m"]
    assert np.array_equal(many.feature, one.feature) and np.array_equal(many.value, one.value)


def test_yield_folds_fit_no_other_model(spark, sf_dir, monkeypatch):
    """The folds need the features only, not the model of all rows."""
    from dataclasses import replace

    from planforge.plans import scores as SC

    fitted, fit = [], B.fit
    monkeypatch.setattr(SC, "YIELD", replace(SC.YIELD, trees=2, depth=2, seed=time.time_ns() % 10**9))  # settings that no stored entry has
    monkeypatch.setattr(SC.B, "fit", lambda df, key, names, label, models, **kw: fitted.append(sorted(models)) or fit(df, key, names, label, models, **kw))
    assert SC.yield_fold_scores(spark, sf_dir).count() > 0
    assert fitted == [[f"fold_{i}" for i in range(SC.FOLDS)]]


def test_saved_models_are_fitted_side_by_side(spark, sf_dir, monkeypatch):
    from threading import Barrier
    from types import SimpleNamespace

    from planforge.queries import models as M

    together = Barrier(3)  # opens once all three builds have begun

    def build(spark, sf):
        together.wait(timeout=30)
        return lambda table: spark.createDataFrame([("m", 0, None, 0.5)], "model string, tree int, feature string, base double")

    for name in ("demand", "failures", "yields"):
        monkeypatch.setattr(M.SC, name, build)
    monkeypatch.setattr(M.store, "of_data", lambda spark, sf: SimpleNamespace(metadata=lambda name: {"target": "t", "features": ["a", "b"]}))
    got = {r["entry"]: tuple(r)[1:] for r in M.l21_saved_model(spark, sf_dir).collect()}
    assert got == dict.fromkeys(("demand", "failure", "yield"), ("m", "t", 2, 1, 1, 1, 0.5))


def test_leaf_tables_are_worked_out_once_a_core():
    assert [S.tasks_for(n, 8) for n in (0, 9000, 74_330, 10**6)] == [1, 2, 8, 15]  # 18 for 74,330 rows before
    assert S.LeafTable(np.array([-1]), np.zeros(1), np.ones(1), np.ones(1)).table.shape == (0, 1)
