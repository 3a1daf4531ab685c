"""Exact top-k search (7): KD-trees per shard over integer vectors, with the k-th score handed on."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planforge.llm.common import materialize, read

FOUND = "query_id long, vec_id long, score long"


class KDTree:
    """Median splits on the widest side; every node keeps the tight box and the smallest id of its points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 64):
        order = np.argsort(ids, kind="stable")
        self.points, self.ids = points[order], ids[order]
        self.low, self.high, self.least, self.kids, self.rows = [], [], [], [], []
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            p, node = self.points[rows], len(self.kids)
            lo, hi = p.min(axis=0), p.max(axis=0)
            self.low.append(lo)
            self.high.append(hi)
            self.least.append(self.ids[rows[0]])
            self.kids.append([-1, -1])
            self.rows.append(None)
            if parent >= 0:
                self.kids[parent][side] = node
            if len(rows) <= leaf:
                self.rows[node] = rows
                continue
            axis = int(np.argmax(hi - lo)) if p.shape[1] else 0
            by = np.argsort(p[:, axis], kind="stable") if p.shape[1] else np.arange(len(rows))
            half = len(rows) // 2
            todo.append((np.sort(rows[by[half:]]), node, 1))
            todo.append((np.sort(rows[by[:half]]), node, 0))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that a point in each node's box can have with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, q: np.ndarray, own: int, bound: np.ndarray, k: int, kth: float) -> list[tuple[int, int]]:
        """Best-first: up to k (score, id), by score and then smaller id, of those that score kth at least."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst on top
        todo = [(-bound[0], 0)]
        while todo:
            top, node = heapq.heappop(todo)
            if -top < kth:
                break
            if len(best) == k and (-top, -self.least[node]) < best[0]:
                continue  # at an equal score only smaller ids could still enter
            rows = self.rows[node]
            if rows is None:
                for child in self.kids[node]:
                    heapq.heappush(todo, (-bound[child], child))
                continue
            scores = self.points[rows] @ q
            for r in np.flatnonzero(scores >= (kth if len(best) < k else max(kth, best[0][0]))):
                i = int(self.ids[rows[r]])
                if i != own:
                    item = (int(scores[r]), -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return [(s, -i) for s, i in best]


def _search_shard(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(vectors) and len(queries):
            # sums of products stay exact in doubles below 2**53, and then BLAS does them
            v, q = np.stack(vectors["v"].to_numpy()), np.stack(queries["v"].to_numpy())
            v, q = v.astype(np.int64), q.astype(np.int64)
            if v.size and float(np.abs(v).max()) * float(np.abs(q).max()) * max(1, v.shape[1]) < 2**53:
                v, q = v.astype(float), q.astype(float)
            tree = KDTree(v, vectors["vec_id"].to_numpy(dtype=np.int64))
            for at in range(0, len(q), 512):
                bounds = tree.bounds(q[at : at + 512])
                for j, bound in enumerate(bounds):
                    row = queries.iloc[at + j]
                    kth = -math.inf if pd.isna(row["kth"]) else row["kth"]
                    out += [(row["vec_id"], i, s) for s, i in tree.search(q[at + j], row["vec_id"], bound, k, kth)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """vec_id and v = floor(scale * x) as longs; vectors null or with null or non-finite components are left out."""
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null and v is not null")
    kept = kept.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 4096, block_rows: int = 4096
) -> DataFrame:
    """vectors: vec_id, v. For each row with is_query its k best others by inner product: query_id, rank, vec_id, score.

    Vectors go by a hash of their id to shards of about ``shard_rows``, queries to blocks of about
    ``block_rows``. Each query first searches its own shard's tree; the k-th score found there is
    handed to the searches of all other shards, which prune boxes that can't reach it. A task holds
    one shard and one block, whatever the table's size; every (block, shard) pair is one task's group.

    Ties go to the smaller id. Fewer than k others give fewer rows. Only vectors of one length are
    compared. Rows repeated with one id are each other's candidates only if their ids differ. An
    empty table gives an empty result.
    """
    vectors = vectors.withColumn("dim", F.size("v"))
    counts = vectors.select(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    shards, blocks = max(1, math.ceil(counts["n"] / shard_rows)), max(1, math.ceil(counts["q"] / block_rows))
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    queries = placed.where(is_query).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)))
    everywhere = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    key = ["dim", "shard", "block"]

    def searched(q: DataFrame) -> DataFrame:
        q = q.select(*[F.col(c).alias(c) for c in q.columns])  # columns of its own, apart from the other side's
        return everywhere.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(_search_shard(k), FOUND)

    home = materialize(searched(queries.withColumn("kth", F.lit(None).cast("double"))), "knn-home")
    kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") >= k)
    away = queries.join(kth.select(F.col("query_id").alias("vec_id"), "kth"), "vec_id", "left")
    away = away.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))).where("other <> shard")
    away = away.drop("shard").withColumnRenamed("other", "shard").select(*queries.columns, "kth")
    found = home.unionByName(searched(away)) if shards > 1 else home
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM scored)
WHERE rn <= 5
"""
