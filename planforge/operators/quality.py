"""Row validation, deduplication, schema checks and ingest metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planforge.functions.columns import md5_key


@dataclass(frozen=True)
class TableSpec:
    """What is checked of a raw table."""

    name: str
    keys: tuple[str, ...]
    yields: tuple[str, ...] = ()
    quantities: tuple[str, ...] = ()
    date: str | None = None
    first_date: str = "1900-01-01"
    last_date: str = "9999-12-31"


def reasons(spec: TableSpec) -> Column:
    """Array of the faults of a row; empty if it has none."""
    found = [F.when(F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == ""), F.lit(f"NULL_PRIMARY_KEY:{k}")) for k in spec.keys]
    for y in spec.yields:
        found.append(F.when(~F.col(y).between(0, 1), F.format_string(f"YIELD_OUT_OF_RANGE:{y}=%.4f", F.col(y).cast("double"))))
    for q in spec.quantities:
        found.append(F.when(F.col(q) < 0, F.concat(F.lit(f"NEGATIVE_QUANTITY:{q}="), F.col(q).cast("string"))))
    if spec.date:
        text = F.col(spec.date).cast("string")
        day = F.substring(text, 1, 10).try_cast("date")
        found.append(F.when(text.isNotNull() & day.isNull(), F.concat(F.lit(f"INVALID_DATE:{spec.date}="), text)))
        outside = ~day.between(F.lit(spec.first_date).cast("date"), F.lit(spec.last_date).cast("date"))
        found.append(F.when(outside, F.concat(F.lit(f"DATE_OUT_OF_RANGE:{spec.date}="), text)))
    return F.array_compact(F.array(*found))


def validate(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Adds is_valid and invalid_reason (faults joined by ``; ``)."""
    found = df.withColumn("_faults", reasons(spec))
    return found.withColumns({"is_valid": F.size("_faults") == 0, "invalid_reason": F.array_join("_faults", "; ")}).drop("_faults")


def add_metadata(df: DataFrame, source: str, run_id: str, ingested_at: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run columns; an is_valid that is already there is never overwritten."""
    new = {"src_system": F.lit(source), "pipeline_run_id": F.lit(run_id), "ingestion_ts": ingested_at}
    if "is_valid" not in df.columns:
        new |= {"is_valid": F.lit(True), "invalid_reason": F.lit("")}
    if keys:
        new["bronze_id"] = md5_key(*keys, ingested_at.cast("string"))
    return df.withColumns(new)


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def schema_faults(df: DataFrame, declared: T.StructType) -> list[str]:
    """What df lacks of a declared schema; looks at metadata only."""
    have = {f.name: f.dataType for f in df.schema}
    missing = [f"MISSING:{f.name}" for f in declared if f.name not in have]
    return missing + [f"TYPE:{f.name}={have[f.name].simpleString()}" for f in declared if f.name in have and have[f.name] != f.dataType]


def ingest_summary(df: DataFrame, table: Column) -> DataFrame:
    """Rows, valid and invalid rows and their share by table, and over all tables."""
    counts = [F.count("*").alias("rows_written"), F.count_if("is_valid").alias("rows_valid"), F.count_if(~F.col("is_valid")).alias("rows_invalid")]
    per = df.groupBy(table.alias("table_name")).agg(*counts)
    total = per.agg(*[F.sum(c).cast("long").alias(c) for c in ("rows_written", "rows_valid", "rows_invalid")]).select(F.lit("TOTAL").alias("table_name"), "*")
    share = F.try_divide(100.0 * F.col("rows_invalid"), F.col("rows_written"))
    return per.unionByName(total).withColumn("invalid_pct", share)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values, least and largest as text; one aggregate in all."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in df.columns:
        text = F.col(c).cast("string")
        aggs.append(F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.countDistinct(c).alias("values"), F.min(text).alias("least"), F.max(text).alias("largest")).alias(c))
    kinds = dict(df.dtypes)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("column_type"), F.col(c).alias("s")) for c in df.columns])
    out = df.agg(*aggs).select("n_rows", F.explode(rows).alias("r"))
    return out.select("r.column_name", "r.column_type", "n_rows", F.col("r.s.nulls").alias("n_nulls"), F.col("r.s.values").alias("n_distinct"), F.col("r.s.least").alias("least"), F.col("r.s.largest").alias("largest"))
