"""Exact dedup (4): local, salted and global combining of equal texts, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.llm.common import materialize, read


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group (no normalisation; null counts as empty) and the largest id stays.

    1. ``local``: the partial aggregate on (digest, salt, text) drops repeats before anything is
       shuffled; its final step merges one salted part of a digest group, so that a text held by a
       third of all rows is spread over ``salts`` tasks.
    2. ``winners``: the few salt winners of a digest meet and are merged on digest *and text*.
    Texts are grouping keys in both steps, so full contents are compared, never digests alone.
    Rows then find their group by digest; should a digest ever hold two texts, the job fails
    instead of answering wrongly. That join is left outer from the rows, so that adaptive execution
    can split a hot digest.

    Repeated rows (same id and text) are rows of one group: each is counted and returned, and all
    copies of the winning id are kept. A null id never wins over another id. An empty table gives
    an empty result. Only the two named columns are read, so other columns can't clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_digest"))
    local = (
        rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("_digest", "_salt", "_text")
        .agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_n"))
    )
    # one exchange on the digest serves both groupings below
    winners = local.repartition("_digest").groupBy("_digest", "_text").agg(F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))
    by_digest = winners.groupBy("_digest").agg(
        F.count("*").alias("_texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    # two texts under one SHA-256: stop the job rather than merge them
    one_text = F.when(F.col("_texts") > 1, F.raise_error(F.lit("different texts share a SHA-256 digest"))).otherwise(F.col("_digest"))
    groups = by_digest.where("group_size > 1").select(one_text.alias("_d"), "keep_id", "group_size")
    groups = materialize(groups, "exact-groups")  # a join side of its own, so that a hot digest's rows can be split
    out = rows.select("doc_id", "_digest").join(groups, F.col("_digest") == F.col("_d"), "left")
    return out.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_id") == F.col("doc_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, salts: int = 32) -> DataFrame:
    """The rows of docs that stay, one of each text, in the columns of docs; steps and ties as above.

    Rows travel with their text: first the largest id of a salted part of a digest group, then the
    largest of those. Of repeated rows one stays; a null id stays only if its group has no other.
    """
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("_salt"), text.alias("_text"),
        F.struct(F.col("doc_id"), F.col("text").isNull().alias("was_null")).alias("_order"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"),
    )
    best = [F.max_by("_row", "_order").alias("_row"), F.max("_order").alias("_order")]
    local = rows.groupBy("_digest", "_salt", "_text").agg(*best)
    winners = local.groupBy("_digest", "_text").agg(*best)
    text = F.when(~F.col("_order.was_null"), F.col("_text")).alias("text")
    return winners.select(*[text if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
