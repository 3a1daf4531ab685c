"""Mixing sources to target weights (8) by pivotal dependent rounding along a reduction tree."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planforge.llm.common import materialize, read, word_count

#: Words of a document, repeated over the sources in order of code points, nulls last.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target.

    ``share`` of all sizes is dealt to the sources by weight; a target stops at ``most`` times its
    source's size and the excess is dealt again by weight until none is above. That fixed point is
    min(cap, level * weight): ordered by cap/weight, the capped sources come first, and the level
    follows from running sums. Windows here run over one row per source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    per = per.withColumn("total", share * F.sum("source_size").over(everything))
    per = per.withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    per = per.withColumn("level", F.coalesce(F.max(fits).over(everything), F.lit(float("inf"))))
    return per.select("source", "source_size", "n_rows", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _round_group(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Sequential pivotal rounding of one bounded group; leaves one fractional row at most.

    Two fractional rows exchange words until one of them holds none or all of its own. The
    direction is drawn so that neither expectation moves, and the words of the pair stay the same.
    """
    pdf = pdf.sort_values(["doc_id", "size", "n"], kind="stable", na_position="last").reset_index(drop=True)
    x, mass, u = pdf["x"].to_numpy(copy=True), (pdf["size"] * pdf["n"]).to_numpy(dtype=float), pdf["u"].to_numpy()
    held = -1
    for j in range(len(x)):
        if not 0 < x[j] < 1:
            continue
        if held < 0:
            held = j
            continue
        i = held
        up, down = min((1 - x[i]) * mass[i], x[j] * mass[j]), min(x[i] * mass[i], (1 - x[j]) * mass[j])
        if u[j] * (up + down) < down:
            i_full, j_empty = (1 - x[i]) * mass[i] <= x[j] * mass[j], x[j] * mass[j] <= (1 - x[i]) * mass[i]
            x[i], x[j] = (1.0 if i_full else x[i] + up / mass[i]), (0.0 if j_empty else x[j] - up / mass[j])
        else:
            i_empty, j_full = x[i] * mass[i] <= (1 - x[j]) * mass[j], (1 - x[j]) * mass[j] <= x[i] * mass[i]
            x[i], x[j] = (0.0 if i_empty else x[i] - down / mass[i]), (1.0 if j_full else x[j] + down / mass[j])
        held = i if 0 < x[i] < 1 else j if 0 < x[j] < 1 else -1
    if last and held >= 0:
        x[held] = 1.0 if u[held] * 99991 % 1 < x[held] else 0.0  # lower digits: the higher ones have been used
    pdf["x"] = x
    return pdf


def _rounding(last: bool):
    return lambda pdf: _round_group(pdf, last)


def copies_per_document(rows: DataFrame, seed: int = 8, group_rows: int = 2048, fan_in: int = 64) -> DataFrame:
    """rows: doc_id, source, size. One row per distinct (doc_id, source, size) with source_size, target and copies.

    A document of a source with target t and size s gets t/s copies: the whole part at once, the
    rest by rounding. Documents of a source are spread by a hash of their id over groups of about
    ``group_rows``; each group leaves one fractional document at most, and those meet ``fan_in``
    groups at a time until one per source is left, which is rounded alone. So a source's words
    differ from its target by less than one document, whatever the number of groups, and a hot
    source is many groups. Draws depend on ids and seed only: reruns agree.
    """
    targets = materialize(source_targets(rows), "mix-targets")
    most = targets.agg(F.max("n_rows").alias("n")).first()["n"] or 0
    units = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    same_source = units["source"].eqNullSafe(targets["source"])
    units = units.join(targets, same_source, "left").drop(targets["source"])
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    buckets = F.ceil(F.col("n_rows") / F.lit(group_rows))
    units = units.select(
        "doc_id", "source", "size", "n", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("x"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), buckets).alias("bucket"),
    )
    schema = "doc_id long, source string, size long, n long, source_size long, target double, whole long, x double, bucket long, u double"
    levels = 1 + math.ceil(math.log(max(1, math.ceil(most / group_rows)), fan_in))
    settled = None
    for level in range(levels):
        last = level == levels - 1
        draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1 + level), "doc_id", "size"), 11) + 0.5) / float(1 << 53)
        key = F.lit(0).cast("long") if last and level else F.floor(F.col("bucket") / fan_in) if level else F.col("bucket")
        grouped = units.withColumn("bucket", key).withColumn("u", draw).groupBy("source", "bucket")
        moved = grouped.applyInPandas(_rounding(last), schema)
        moved = materialize(moved, "mix-level") if not last else moved
        whole = moved if last else moved.where("not (x > 0 and x < 1)")
        settled = whole if settled is None else settled.unionByName(whole)
        units = moved.where("x > 0 and x < 1").drop("u")
    return settled.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("x")).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    A null text or one without words has size 0 and no copies. Null sources are a source of their
    own, ranked last. Rows repeated with equal id, source and size get the same number of copies.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = materialize(rows, "mix-sizes")
    got = copies_per_document(rows, **options).select(F.struct("doc_id", "source", "size").alias("k"), "source_size", "target", "copies")
    joined = rows.join(got, F.struct("doc_id", "source", "size").eqNullSafe(F.col("k")), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_by_copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it was dealt copies, in the columns of docs."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # names of docs can't clash with those in here
    keyed = docs.select(row, F.struct(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size")).alias("key"))
    got = mix_sources(docs, **options).select(F.struct("doc_id", "source", "size").alias("k"), "copies").distinct().where("copies > 0")
    joined = keyed.join(got, F.col("key").eqNullSafe(F.col("k")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
