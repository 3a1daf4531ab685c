"""A store of models and of the tables that they give: versions in folders of their own, and a pointer to the current one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planforge.sources import io


class Store:
    """Named entries under a root folder that all executors share.

    ``publish`` writes the tables of a version and its metadata, and then moves the pointer by one
    rename, so a reader sees the version before or the new one, never a part. Versions before are
    kept until ``prune``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._fs.Path("/".join([self.root, *parts]))

    def _context(self):
        return self._fs.FileContext.getFileContext(self._fs.Path(self.root).toUri(), self._conf)

    def _write(self, text: str, *parts: str) -> None:
        path = self._at(*parts)
        out = path.getFileSystem(self._conf).create(path, True)
        out.write(text.encode())
        out.close()

    def _read(self, *parts: str) -> str | None:
        path = self._at(*parts)
        if not path.getFileSystem(self._conf).exists(path):
            return None
        return "\n".join(r["value"] for r in self.spark.read.text(str(path)).collect())  # a few lines

    def publish(self, name: str, tables: dict[str, DataFrame], metadata: dict) -> str:
        version = uuid.uuid4().hex
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{version}/{table}")
        schemas = {table: df.schema.json() for table, df in tables.items()}
        self._write(json.dumps(metadata | {"tables": sorted(tables), "schemas": schemas}), name, version, "metadata.json")
        self._write(version, name, f"pointer-{version}")
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._context().rename(self._at(name, f"pointer-{version}"), self._at(name, "current"), options)
        return version

    def current(self, name: str) -> str | None:
        """The current version, or None."""
        return self._read(name, "current")

    def metadata(self, name: str, version: str | None = None) -> dict | None:
        text = self._read(name, version or self.current(name) or "none", "metadata.json")
        return json.loads(text) if text else None

    def table(self, name: str, table: str, version: str | None = None) -> DataFrame:
        """A table of the current version, or of one named."""
        return self.spark.read.parquet(f"{self.root}/{name}/{version or self.current(name)}/{table}")

    def versions(self, name: str) -> list[str]:
        path = self._at(name)
        system = path.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()) if system.exists(path) else []

    def prune(self, name: str) -> None:
        """Delete all versions but the current one."""
        now = self.current(name)
        for v in self.versions(name):
            if v != now:
                path = self._at(name, v)
                path.getFileSystem(self._conf).delete(path, True)

    def fresh(self, name: str, source: str, build: Callable[[], tuple[dict[str, DataFrame], dict]]) -> str:
        """The current version if it was built from ``source``, else a new one."""
        found = self.metadata(name)
        if found and found.get("source") == source:
            return self.current(name)
        tables, metadata = build()
        return self.publish(name, tables, metadata | {"source": source})


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Paths with their files' sizes and times, so that a changed table is told from what was read before."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(conf).listFiles(path, True)
        sizes = times = n = 0
        while files.hasNext():
            f = files.next()
            sizes, times, n = sizes + f.getLen(), max(times, f.getModificationTime()), n + 1
        out.append(f"{p}:{n}:{sizes}:{times}")
    return ";".join(out)


def of_data(spark: SparkSession, sf_dir: str) -> Store:
    """The store of a data folder, in the shared folder of the session."""
    import hashlib

    return Store(spark, f"{io.shared_dir(spark)}/models-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}")
