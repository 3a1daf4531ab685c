"""Readers and writers of layers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, one in the warehouse, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_planforge_scratch").rstrip("/")


def checkpoint_dir(spark: SparkSession) -> None:
    """Have a folder for ``checkpoint()``: the session's own, else one in the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def read_splits(spark: SparkSession, path: str, split_mb: int) -> DataFrame:
    """A scan in input splits of a size of its own, which takes the place of LIMIT/OFFSET chunks.

    The size is a setting of a session, not of a reader: the frame belongs to a session beside the given one.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", f"{split_mb}m")
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    return own.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int) -> DataFrame:
    """A row-store table read in parallel ranges of a numeric key."""
    options = {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": partitions}
    return spark.read.format("jdbc").options(**options).load()


def overwrite(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], order: list[str]) -> DataFrame:
    """Folders by partition columns, files sorted inside: which serves where a row store has secondary indexes.

    Rows of one folder may be dealt to several tasks: rebalance splits a large folder.
    """
    df.hint("rebalance", *by).sortWithinPartitions(*by, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _with(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def brief_shuffles(spark: SparkSession):
    """Writes inside leave no shuffle files: Spark deletes those of a query when it ends."""
    return _with(spark, _CLEANUP, "true")


def joined_where_dealt(spark: SparkSession):
    """Writes inside join rows that are dealt by some of their keys without dealing them by all."""
    return _with(spark, _ALL_KEYS, "false")


#: Bytes of a row group of folded rows. A scan decodes up to 4,096 rows at once, but none of two groups: rows may hold very long arrays.
ROW_GROUP = 8 << 20


def add_months(df: DataFrame, path: str, by: str, order: list[str]) -> None:
    """Rows in folders of their month, to those that are there. Each file is in order, and a large month is split into several."""
    with brief_shuffles(df.sparkSession):
        df.hint("rebalance", by).sortWithinPartitions(by, *order).write.mode("append").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy(by).parquet(path)


def written(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Scratch rows written, compressed well, without leaving shuffle files behind."""
    with brief_shuffles(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def create_views(views: dict[str, DataFrame]) -> int:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return len(views)


def csv_round_trip(df: DataFrame, path: str) -> DataFrame:
    """Export with header and quotes, and what a reader gets of it."""
    df.write.option("header", True).option("escape", '"').csv(path)
    return df.sparkSession.read.option("header", True).option("escape", '"').schema(df.schema).csv(path)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()])
