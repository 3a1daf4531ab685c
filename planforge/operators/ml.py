"""Encoding, sampling and scoring around the models, and the isolation forest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planforge.operators.neighbours import nearest
from planforge.sources import io


def category_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Alphabetical codes from 0; the tables of values are small and fitted once."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_code", stringOrderType="alphabetAsc", handleInvalid="keep") for c in columns]
    return Pipeline(stages=stages).fit(df).transform(df)


def features(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """A vector of numeric columns, NULL and NaN as 0."""
    return df.withColumn(out, array_to_vector(F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])))


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores over all rows, from one aggregate; 0 where there is no spread."""
    stats = df.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns])
    out = df.join(F.broadcast(stats), F.lit(True))  # one row
    return out.withColumns({f"{c}_z": F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s")), F.lit(0.0)) for c in columns}).drop(*[f"{c}_{x}" for c in columns for x in "ms"])


def oversample(df: DataFrame, label: str, columns: list[str], key: list[str], k: int = 5, seed: int = 11) -> DataFrame:
    """Rows of label 0 and 1, and points between rows of label 1 and one of their k nearest, until both labels are as many.

    Neighbours are sought among all rows of label 1 (``nearest``, exact). Every such row gives as many points as the others,
    or one more; which neighbour and how far on the way to it come from a hash of (row, number), so reruns agree. Rows are told apart
    by ``key``; where keys repeat, any order among their rows is taken. Fewer than two rows of label 1, or no fewer than
    of label 0, add nothing. Null columns count as 0.
    """
    spark = df.sparkSession
    rows = df.select(F.col(label).cast("int").alias(label), *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns], F.xxhash64(*key).alias("_h"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)])
    sizes = rows.agg(F.count_if(F.col(label) == 1).alias("rare"), F.count_if(F.col(label) == 0).alias("common")).first()
    rare, missing = sizes["rare"], sizes["common"] - sizes["rare"]
    base = rows.select(label, *columns)
    if rare < 2 or missing <= 0:
        return base
    # numbers from 0 without a window over all rows: counts of hash ranges, summed up to each, and a number inside it
    parts = min(4096, max(1, rare // 10000))
    some = rows.where(F.col(label) == 1).withColumn("_b", F.pmod("_h", F.lit(parts)))
    before = some.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_n", F.sum("_n").over(W.orderBy("_b")) - F.col("_n"))  # 4,096 rows at most
    inside = F.row_number().over(W.partitionBy("_b").orderBy("_h", *[f"_k{i}" for i in range(len(key))], *columns)) - 1
    some = some.withColumn("_in", inside).join(F.broadcast(before), "_b").select((F.col("_in") + F.col("_n")).cast("long").alias("id"), *columns)
    some = io.overwrite(some, io.scratch(spark, "oversample"))
    near = nearest(some, "id", columns, k)
    at = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "id", "s")
    copies = F.lit(missing // rare) + F.when(F.col("id") < missing % rare, 1).otherwise(0)
    drawn = some.select("id", F.array(*columns).alias("x"), F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies.cast("long")))).alias("s"))
    drawn = drawn.withColumn("rank", (F.pmod(at(1), F.lit(min(k, rare - 1))) + 1).cast("int"))
    drawn = drawn.join(near.select("id", "rank", "other"), ["id", "rank"]).join(some.select(F.col("id").alias("other"), F.array(*columns).alias("y")), "other")
    u = F.shiftrightunsigned(at(2), 11) / float(1 << 53)
    made = drawn.select(F.zip_with("x", "y", lambda a, b: a + u * (b - a)).alias("v"))
    return base.unionByName(made.select(F.lit(1).alias(label), *[F.col("v")[i].alias(c) for i, c in enumerate(columns)]))


def stratified_folds(df: DataFrame, label: str, key: list[str], folds: int) -> DataFrame:
    """Folds by a hash of the key, dealt separately to each label."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(label), *key), F.lit(folds)))


def classifier_scores(scored: DataFrame, probability: str) -> dict[str, float]:
    return {m: BinaryClassificationEvaluator(labelCol="label", rawPredictionCol=probability, metricName=m).evaluate(scored) for m in ("areaUnderPR", "areaUnderROC")}


# isolation forest


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, most: int):
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
    if depth >= most or len(x) <= 1 or not len(spread):
        return float(len(x))
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    return f, cut, _grow(x[x[:, f] <= cut], rng, depth + 1, most), _grow(x[x[:, f] > cut], rng, depth + 1, most)


def _unsuccessful(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _path(x: np.ndarray, tree, depth: int = 0) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), depth + _unsuccessful(tree))
    f, cut, left, right = tree
    out, low = np.empty(len(x)), x[:, f] <= cut
    out[low], out[~low] = _path(x[low], left, depth + 1), _path(x[~low], right, depth + 1)
    return out


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = 200, sample: int = 256, contamination: float = 0.05, seed: int = 13) -> DataFrame:
    """key, score (higher: more normal), is_anomaly for the lowest share ``contamination``.

    Every tree draws its rows by a hash of (tree, key) below a threshold that gives about ``sample``
    rows; trees are built side by side, one group each, and broadcast: their size is fixed.
    """
    import pickle

    n = df.count()
    rows = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    u = lambda t: F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, F.col(key)), 11) / float(1 << 53)
    its = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: u(t) < sample / max(n, 1))
    drawn = rows.withColumn("tree", F.explode(its))  # a row is copied only for the trees that drew it

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        t = int(pdf["tree"].iloc[0])
        tree = _grow(pdf[columns].to_numpy(float), np.random.default_rng([seed, t]), 0, math.ceil(math.log2(sample)))
        return pd.DataFrame({"tree": [t], "n": [len(pdf)], "model": [pickle.dumps(tree)]})

    built = drawn.groupBy("tree").applyInPandas(build, "tree int, n int, model binary").orderBy("tree").collect()  # trees of fixed size
    shared = df.sparkSession.sparkContext.broadcast([(r["n"], pickle.loads(r["model"])) for r in built])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[columns].to_numpy(float)
            ratio = np.mean([_path(x, t) / max(_unsuccessful(float(m)), 1e-9) for m, t in shared.value], axis=0) if shared.value else np.zeros(len(x))
            yield pd.DataFrame({key: pdf[key], "score": -(2.0**-ratio)})

    kind = dict(df.dtypes)[key]
    scored = rows.mapInPandas(score, f"{key} {kind}, score double")
    cut = scored.agg(F.percentile_approx("score", contamination, 100000).alias("_cut"))
    return scored.join(F.broadcast(cut), F.lit(True)).select(key, "score", (F.col("score") <= F.col("_cut")).alias("is_anomaly"))  # one row


def residuals(actual: Column, predicted: Column) -> dict[str, Column]:
    return {"residual": actual - predicted, "abs_error_pp": F.abs(actual - predicted) * 100}


def risk_alerts(scored: DataFrame, tier: str = "risk_tier") -> DataFrame:
    return scored.where(F.col(tier).isin("HIGH", "CRITICAL")).withColumn("alert_ts", F.current_timestamp())
