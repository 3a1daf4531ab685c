"""Telemetry as a stream: what has arrived is taken, repeats within the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def deduplicated_stream(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], event_time: str, out: str, late: str = "30 days") -> DataFrame:
    """Reads the files of path once as a stream, drops repeated keys and appends the rest to out.

    Progress and state are kept under out, so that a later call goes on where this one ended.
    """
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    rows = rows.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)
    done = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/_state").option("path", f"{out}/rows").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    got = spark.read.parquet(f"{out}/rows")
    return got.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
