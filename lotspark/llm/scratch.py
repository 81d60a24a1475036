"""Intermediate tables in the folder that the cluster shares.

``spark.checkpoint.dir`` names it; every executor and the driver see it, so a
table written there survives lost executors and cuts the lineage of iterative
jobs. Only where all of Spark is one process may the setting be missing: a
temporary folder then stands in and goes when the process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lotspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders of this process that nobody has deleted yet.
_roots: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """A point to which ``release`` goes back."""
    return len(_roots)


def release(since: int = 0) -> None:
    """Delete the folders made since ``mark``. Results that still read them have to be written before."""
    while len(_roots) > since:
        _delete(*_roots.pop())


#: Spark's setting by which a query's shuffle files go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables under one fresh folder of the shared directory.

    Without ``keep_shuffles`` the shuffle files of a table go once it is written, not
    only when the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession, label: str, keep_shuffles: bool = True):
        self.spark = spark
        self.keep_shuffles = keep_shuffles
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        _roots.append((spark, self.root))

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, before if self.keep_shuffles else "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no pending result reads any more."""
        for table in tables:
            _delete(self.spark, table._scratch_path)
