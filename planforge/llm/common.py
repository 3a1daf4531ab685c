"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract: the six ASCII white-space bytes.
WORD_GAPS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs as a long; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, WORD_GAPS), lambda w: w != "")), F.lit(0)).cast("long")


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null keys fall in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, one in the warehouse, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_planforge_shared"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    The files outlive lost executors; ``release`` drops them, or the file system when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, system = _file_system(spark, path)
    system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from ``materialize`` once nothing that is still to run reads them."""
    for df in tables:
        at, system = _file_system(df.sparkSession, df.written_to)
        system.delete(at, True)


class Tables:
    """Writes the intermediate tables of one run, and drops them together."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(materialize(df, name))
        return self.made[-1]

    def release(self) -> None:
        release(*self.made)

    def release_all_but(self, result: DataFrame) -> None:
        release(*[df for df in self.made if df is not result])


def in_slices(batch: pa.RecordBatch, column: str = "text", most_rows: int = 512, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have about ``most_bytes`` together; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and (total + n > most_bytes or i - at == most_rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)
