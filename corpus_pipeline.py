"""The training-data pipeline: toxicity, exact and near dedup, mixing and packing of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.llm.common import materialize, read, release
from planforge.llm.exact_dedup import drop_exact_copies
from planforge.llm.mixing import repeat_by_copies
from planforge.llm.near_dedup import near_duplicates
from planforge.llm.packing import best_fit_pack
from planforge.llm.toxicity import fitted_scorer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; null and empty texts are scored too, and rows with one id each by their own text."""
    score = fitted_scorer(docs, read(spark, sf_dir, "labels"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn("_toxicity", score(F.col("text"))).where("_toxicity.score < 0.5").select(*names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null counts as an empty text, and an id beats a null one."""
    return drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id.

    Where ids are null or repeated, rows are told apart by keys in the order of their ids (null ones
    last, then by the hash of the text), so a row goes for its own text only. Null, empty and wordless
    texts are copies of nothing and stay.
    """
    names, count = [F.col(f"`{c}`") for c in docs.columns], docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if count["rows"] == count["ids"]:
        gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*names)
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).select(F.struct(*names).alias("row"))
    keyed = materialize(ordered.select(F.monotonically_increasing_id().alias("key"), "row"), "near-keyed")
    gone = near_duplicates(keyed.select(F.col("key").alias("doc_id"), "row.text")).where(~F.col("kept")).select(F.col("doc_id").alias("key"))
    return keyed.join(gone, "key", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a text without words has size 0."""
    return repeat_by_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in training sequences; each row is packed, repeated or not, and an empty table gives no rows."""
    return best_fit_pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: Classifying, sketching, rounding and packing can't be said in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written and read again, and those before them dropped."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
