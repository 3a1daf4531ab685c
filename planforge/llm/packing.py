"""Best-fit packing (6): documents into training sequences, without putting conflicting ones together."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.llm.common import read, word_count

PACKED = "doc_id long, source string, piece int, start_word long, n_words long, bin_id string, bin_start long, bin_words long"


def pack_group(sizes, sources, clusters, capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Best-fit decreasing over one bounded group; returns the bin of each item and its start in it.

    Open bins are kept in order of (residual, bin). The search starts at the first bin that is large
    enough, so the tightest, and goes on to its successors until neither bitmap of the bin has the
    item's bit. A bin carries a bitmap of its duplicate clusters and ``per_source`` bitmaps of its
    sources: the k-th has the bit of a source that is there k times.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(clusters))}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    residuals: list[tuple[int, int]] = []
    by_source, by_cluster, used = [], [], []
    at, start = [-1] * len(sizes), [0] * len(sizes)
    for i in order:
        s, c, n = source_bit[sources[i]], cluster_bit[clusters[i]], sizes[i]
        k = bisect_left(residuals, (n, -1))
        while k < len(residuals) and (by_cluster[b := residuals[k][1]] & c or by_source[b][-1] & s):
            k += 1
        if k < len(residuals):
            left, b = residuals.pop(k)
        else:
            left, b = capacity, len(used)
            by_source.append([0] * per_source)
            by_cluster.append(0)
            used.append(0)
        at[i], start[i] = b, used[b]
        used[b] += n
        by_cluster[b] |= c
        maps = by_source[b]
        maps[next(j for j in range(per_source) if not maps[j] & s)] |= s
        if left > n:
            insort(residuals, (left - n, b))
    return at, start


def _runs(counted: DataFrame, most: int) -> DataFrame:
    """Rows of at most ``most`` copies each, numbered by run; in two steps, so that no array grows with a count."""
    copies, large = F.col("copies"), most * 4096
    for column, step in (("_large", large), ("_small", most)):
        counted = counted.withColumn(column, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((copies - 1) / step))))
        counted = counted.withColumn("copies", F.least(copies - F.col(column) * step, F.lit(step)))
    return counted.withColumn("run", F.col("_large") * 4096 + F.col("_small")).drop("_large", "_small")


def best_fit_pack(
    docs: DataFrame, capacity: int = 2048, per_source: int = 2, group_docs: int = 1024, cluster_col: str | None = None
) -> DataFrame:
    """One row per piece of a document: doc_id, source, piece, start_word, n_words, bin_id, bin_start, bin_words.

    Sizes are words. A document of n words has n // capacity pieces that fill bins of their own and
    a rest that is packed; no bin holds two documents of a duplicate cluster (``cluster_col``, by
    default equal texts) or more than ``per_source`` of a source. Documents are packed in groups
    of about ``group_docs`` by a hash of their id, source, size and cluster, so that a hot source or cluster, or
    an id that many rows have, is spread, a task is bounded and reruns agree; bins don't cross groups.
    Rows equal in all four (null ids with one text, say) can't be told apart in the result: they are counted
    first, and dealt to groups in runs of at most ``group_docs / 16``. So packing, whose search is quadratic in
    conflicting documents of a group, meets no group that grows with the table.

    Texts without words (null ones too) give one piece of 0 words without a bin. Repeated rows are
    packed each, never into one bin; among equal sizes the smaller id, then source, then cluster comes first. Null ids, sources and clusters are values like others; an empty
    table gives an empty result.
    """
    cluster = F.xxhash64(F.coalesce("text", F.lit(""))) if cluster_col is None else F.xxhash64(F.col(cluster_col))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("n"), cluster.alias("cluster"))
    total = docs.select(F.count(F.lit(1)).alias("n")).first()["n"]
    groups = max(1, math.ceil(total / group_docs))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])]
        pdf = pdf.sort_values(["doc_id", "source", "n", "cluster"], kind="stable", na_position="last")
        g = int(pdf["g"].iloc[0])
        ids, sources = pdf["doc_id"].tolist(), pdf["source"].tolist()
        sizes, clusters = pdf["n"].tolist(), pdf["cluster"].tolist()
        rest = [i for i, n in enumerate(sizes) if n % capacity]
        at, start = pack_group([sizes[i] % capacity for i in rest], [sources[i] for i in rest], [clusters[i] for i in rest], capacity, per_source)
        filled: dict[int, int] = {}
        for i, b in zip(rest, at, strict=True):
            filled[b] = filled.get(b, 0) + sizes[i] % capacity
        out, own = [], 0
        for i, n in enumerate(sizes):
            for p in range(n // capacity):
                out.append((ids[i], sources[i], p, p * capacity, capacity, f"{g}-f{own}", 0, capacity))
                own += 1
            if not n:
                out.append((ids[i], sources[i], 0, 0, 0, None, None, None))
        for i, b, s in zip(rest, at, start, strict=True):
            n, p = sizes[i] % capacity, sizes[i] // capacity
            out.append((ids[i], sources[i], p, p * capacity, n, f"{g}-{b}", s, filled[b]))
        frame = pd.DataFrame(out, columns=["doc_id", "source", "piece", "start_word", "n_words", "bin_id", "bin_start", "bin_words"])
        return frame.astype({"doc_id": "Int64", "bin_start": "Int64", "bin_words": "Int64"})

    key = ["doc_id", "source", "n", "cluster"]
    runs = _runs(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")), max(1, group_docs // 16))
    return runs.withColumn("g", F.pmod(F.xxhash64(*key, "run"), F.lit(groups))).drop("run").groupBy("g").applyInPandas(pack, PACKED)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read(spark, sf_dir, "documents"))
