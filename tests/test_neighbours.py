import numpy as np
import pytest
from pyspark.sql import functions as F

from planforge.operators import ml
from planforge.operators.neighbours import nearest


def plain(points, k):
    out = []
    for i, a in points:
        ranked = sorted((sum((p - q) ** 2 for p, q in zip(a, b)), j) for j, b in points if j != i)
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(ranked[:k])]
    return sorted(out)


def found(spark, points, k, **sizes):
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in points], "id long, a double, b double, c double")
    return sorted(tuple(r) for r in nearest(df, "id", ["a", "b", "c"], k, **sizes).collect())


@pytest.mark.parametrize("spread", [3, 1000])  # many ties and equal points, and few
def test_nearest_equals_brute_force(spark, spread):
    rng = np.random.default_rng(spread)
    points = [(int(i), tuple(p)) for i, p in zip(rng.permutation(400), rng.integers(0, spread, (400, 3)).tolist())]
    assert found(spark, points, 5, cell_rows=20) == plain(points, 5)


def test_nearest_of_a_point_that_many_rows_share(spark):
    rng = np.random.default_rng(5)
    points = [(i, (1.0, 1.0, 1.0)) for i in range(150)] + [(i, tuple(map(float, rng.integers(0, 40, 3)))) for i in range(150, 300)]
    assert found(spark, points, 4, cell_rows=10, sample=40) == plain(points, 4)


def test_nearest_of_few_rows_and_nulls(spark):
    assert found(spark, [], 3) == [] and found(spark, [(7, (1, 2, 3))], 3) == []
    assert found(spark, [(7, (1, 2, 3)), (3, (1, 2, 4))], 3) == [(3, 1, 7, 1.0), (7, 1, 3, 1.0)]
    df = spark.createDataFrame([(1, None, 1.0), (2, 0.0, 1.0), (3, -0.0, float("nan"))], "id long, a double, b double")
    got = sorted(tuple(r) for r in nearest(df, "id", ["a", "b"], 1).collect())
    assert got == [(1, 1, 2, 0.0), (2, 1, 1, 0.0), (3, 1, 1, 1.0)]


@pytest.mark.parametrize("common", [53, 500])  # fewer than one new point a row, and many
def test_oversample_balances_between_true_neighbours(spark, common):
    rng = np.random.default_rng(7)
    rare = [(1, *map(float, p)) for p in rng.integers(0, 50, (37, 2))]
    rows = [(i, *r) for i, r in enumerate(rare + [(0, *map(float, p)) for p in rng.integers(0, 50, (common, 2))])]
    df = spark.createDataFrame(rows, "k int, label int, a double, b double")
    got = ml.oversample(df, "label", ["a", "b"], ["k"], k=3)
    out = sorted(tuple(r) for r in got.collect())
    assert sum(r[0] for r in out) == common == sum(1 - r[0] for r in out)
    assert out == sorted(tuple(r) for r in ml.oversample(df.repartition(7), "label", ["a", "b"], ["k"], k=3).collect())
    base = [r[1:] for r in rare]
    left = [r[1:] for r in out if r[0] == 1]
    for p in base:
        left.remove(p)
    near = [sorted((((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2), j) for j, q in enumerate(base) if j != i)[2][0] for i, p in enumerate(base)]
    pairs = [(np.array(p), np.array(q)) for i, p in enumerate(base) for j, q in enumerate(base) if i != j and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= near[i]]
    for v in map(np.array, left):  # on the way from a row to one of its three nearest
        assert any(abs(np.linalg.norm(v - p) + np.linalg.norm(v - q) - np.linalg.norm(p - q)) < 1e-6 for p, q in pairs)


def test_oversample_leaves_what_it_cannot_balance(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (2, 0, None), (3, 0, 1.0)], "k int, label int, a double")
    assert sorted(tuple(r) for r in ml.oversample(df, "label", ["a"], ["k"]).collect()) == [(0, 0.0), (0, 1.0), (1, 2.0)]
    assert ml.oversample(df.where(F.lit(False)), "label", ["a"], ["k"]).count() == 0
