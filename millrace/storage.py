"""Scratch tables in the cluster's shared folder, for results that are read more than once or iterated on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, local mode gets a temporary one; a
    cluster has no folder that all executors are known to share, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """Parquet tables that cut lineage: every executor can read them back, so a lost executor costs no
    recomputation. ``drop`` removes one that nothing reads any more; those that a returned DataFrame still
    reads go when the application ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def _file_system(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``df`` stored and read back; its shuffle files go, as nothing reads them again. ``rows``: how many go to Python
        at a time at most, where they are large."""
        self.count += 1
        path = f"{self.base}/{self.count:03d}"
        most = int(self.spark.conf.get(ROWS))
        if rows is not None and (most <= 0 or rows < most):
            most = rows
        with _set(self.spark, CLEANUP, "true"), _set(self.spark, ROWS, str(most)):
            df.write.option("compression", "zstd").parquet(path)
        if self.count == 1:
            base, files = self._file_system(self.base)
            files.deleteOnExit(base)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path, files = self._file_system(df._scratch_path)
            files.delete(path, True)
