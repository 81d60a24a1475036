"""Places and medians of groups that may be far larger than a task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def with_places(rows: DataFrame, group: list[str], order: list[Column], save: Callable[[DataFrame], DataFrame], name: str = "place") -> DataFrame:
    """``rows`` with each one's place (from 1) in its group, in two passes.

    The rows are dealt in ranges of group and order and saved, so that a row keeps its
    range if a task is run again; a range counts its rows by group, and a place is
    that within the range after the rows of the ranges before. Null groups are a
    group; rows equal in ``order`` get their places in any order; an empty table
    stays empty. Columns named ``_range`` and ``_before`` are replaced.
    """
    dealt = save(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = dealt.withColumn(name, F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order)).cast("long"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_range") == F.col("_r"))
    return inside.join(before, same).select(*rows.columns, (F.col(name) + F.col("_before")).alias(name))


def medians(rows: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Per value of the columns ``by``: n (rows) and median (double, between the two middle values of an even number).

    Equal values are counted before the shuffle and the counts run on to the middle,
    so no task holds a group: its distinct values are sorted, on disk if need be.
    Null values count in n only; without others the median is null. With ``weight``, a
    row stands for as many as that column says.
    """
    counts = rows.groupBy(*by, F.col(value).alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c")).withColumn("_known", F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0))
    own = W.partitionBy(*by).orderBy(F.col("_v").asc_nulls_last())
    upto = counts.withColumn("_upto", F.sum("_known").over(own.rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_known").over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    middle = lambda at: F.min(F.when(F.col("_upto") > F.expr(at), F.col("_v"))).cast("double")
    return upto.groupBy(*by).agg(F.sum("_c").alias("n"), ((middle("(_all - 1) div 2") + middle("_all div 2")) / 2).alias("median"))
