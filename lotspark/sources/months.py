"""Tables in month partitions, of which a job reads those that it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upkeep import months_back


def write_months(df: DataFrame, day: str, path: str) -> None:
    """Rows in partitions ``ym`` (YYYYMM) of their day; a large month is split over tasks. Rows without a day stay, in no month."""
    df.withColumn("ym", F.date_format(day, "yyyyMM")).hint("rebalance", "ym").write.partitionBy("ym").parquet(path)


def read_months(spark: SparkSession, path: str, schema: str, bases: DataFrame, n: int) -> DataFrame:
    """(base, ym, columns of ``schema``): the rows of the n months up to the month of each day ``base``.

    Spark prunes the partitions by the months that ``bases`` turns out to have, if it
    is filtered. What is broadcast is n rows a month at most, however many days there
    are. Null days match nothing.
    """
    months = bases.select(F.trunc("base", "month").alias("base")).distinct().select("base", F.explode(months_back(F.col("base"), n)).alias("ym"))
    table = spark.read.schema(f"{schema}, ym string").parquet(path)
    return table.join(F.broadcast(months), "ym")
