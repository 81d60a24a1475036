"""Micro-batch forms of the upkeep: a change feed upserted by key, links sent once, windows with late data."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import KeyedTable


def change_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of changes as a stream; the checkpoint keeps the high-water mark."""
    return spark.readStream.schema(schema).parquet(path)


def upsert_into(table: KeyedTable, order: str, keep: tuple[str, ...] = ()):
    """``foreachBatch`` function: the latest version of each key of a batch goes into ``table``, whose other buckets stay as they are.

    A version that isn't newer than the table's is dropped, so a batch that is run
    again changes nothing.
    """

    def run(batch: DataFrame, _: int) -> None:
        table.upsert(batch, order, keep)

    return run


def append_batches(path: str):
    """``foreachBatch`` function: each batch becomes partition ``batch`` of the table at ``path``; one that is run again replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def unsent(links: DataFrame, key: str, ts: str, memory: str = "7 days") -> DataFrame:
    """Stream of links that weren't sent within the watermark."""
    return links.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, memory).dropDuplicatesWithinWatermark([key])


def counts_by_window(events: DataFrame, ts: str, kind: str, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts and sums per window and kind, with late rows up to a bound."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def run_once(stream: DataFrame, checkpoint: str, each) -> None:
    """Process what is there with ``each(batch, id)``, then stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", os.fspath(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
