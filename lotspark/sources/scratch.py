"""Tables between the rounds of iterative jobs, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder may stand in only where all of Spark is one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lotspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


#: Spark's setting by which a query's shuffle files go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saver(spark: SparkSession, keep_shuffles: bool = True) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table under ``spark.checkpoint.dir`` and returns it as read back.

    Without ``keep_shuffles`` the shuffle files of a table go once it is written, not
    only when the driver collects its garbage.
    """
    root = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
    done: list[str] = []

    def save(df: DataFrame) -> DataFrame:
        path = f"{root}/{len(done):03d}"
        done.append(path)
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, before if keep_shuffles else "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(CLEANUP, before)
        return spark.read.schema(df.schema).parquet(path)

    return save
