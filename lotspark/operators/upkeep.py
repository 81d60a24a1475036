"""Incremental upkeep of tables: upserts, diffs, backfills, marks, samples and splits.

All are functions of DataFrames; writing what they return is the part of
``sources.versions``. Nothing overwrites a path that it reads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str, *order: str) -> DataFrame:
    """The last version of each key in a change feed."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*(c for c in changes.columns if c != key)), F.struct(*order)).alias("v")).select(key, "v.*")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` (one per key); columns in ``keep`` stay as they are where the key existed."""
    o, n = old.alias("o"), new.alias("n")
    had, has = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.when(had & (F.lit(c in keep) | ~has), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    cols = [F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(pick(c) for c in old.columns if c != key)]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*cols)


def backfill(base: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``base`` with the columns of ``values`` filled in where they are known."""
    cols = [c for c in values.columns if c != key]
    v = values.select(key, *(F.col(c).alias(f"_new_{c}") for c in cols))
    return base.join(v, key, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns))


def snapshot_diff(old: DataFrame, now: DataFrame, key: str, group: str, seen: Column) -> DataFrame:
    """Listings after a crawl: key, group, first_seen, last_seen, is_active.

    ``old`` has those columns, ``now`` key and group. Rows that the crawl of their
    group missed become inactive; groups that weren't crawled stay as they are.
    """
    crawled = now.select(group).distinct().withColumn("crawled", F.lit(True))
    n = now.select(key, F.col(group).alias("g_now")).distinct().withColumn("here", F.lit(True))
    j = old.join(crawled, group, "left").join(n, key, "full")
    here = F.coalesce("here", F.lit(False))
    return j.select(
        key, F.coalesce(group, "g_now").alias(group), F.coalesce("first_seen", seen).alias("first_seen"), F.when(here, seen).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(here, True).when(F.coalesce("crawled", F.lit(False)), False).otherwise(F.col("is_active")).alias("is_active"),
    )


def purge_unseen(table: DataFrame, run: Column, least: int) -> DataFrame:
    """Rows of this run only, provided that it saved ``least`` of them; else all rows. One pass, no action."""
    saved = table.agg(F.count_if(F.col("run") == run).alias("_saved"))
    return table.crossJoin(F.broadcast(saved)).where((F.col("run") == run) | (F.col("_saved") < least)).drop("_saved")


def changed_since(table: DataFrame, mark: Column, column: str = "updated_at") -> DataFrame:
    """Rows newer than a high-water mark."""
    return table.where(F.col(column) > mark)


def next_mark(changes: DataFrame, mark: Column, column: str = "updated_at") -> DataFrame:
    return changes.agg(F.coalesce(F.max(column), mark).alias("mark"))


def invalidated(changes: DataFrame, key: str, uses: dict[str, list[str]]) -> DataFrame:
    """(result, key) to recompute: each result table names the columns that it depends on."""
    tests = [F.when(F.arrays_overlap("changed_fields", F.array(*map(F.lit, cols))), result) for result, cols in uses.items()]
    return changes.select(key, F.explode(F.array_compact(F.array(*tests))).alias("result")).distinct()


def fresh(table: DataFrame, as_of: Column, seconds: int, column: str = "ts") -> DataFrame:
    """Rows younger than a time to live."""
    return table.where(F.col(column) > as_of - F.expr(f"interval {seconds} seconds"))


def still_to_do(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return targets.join(done.select(key), key, "left_anti")


NO_DATA_DAYS = 3


def until_covered(targets: DataFrame, job, key: str, marks: DataFrame, as_of: Column, days: int = NO_DATA_DAYS) -> DataFrame:
    """Rows of ``job`` on what is still open, round after round, until one covers nothing new.

    ``job`` writes what it returns: the key, ``found`` and more. Rows without ``found``
    mark keys that have no data; like the ``marks`` (key, ts) of earlier runs they are
    left alone for ``days``. Keys that a round returns no row for are tried again.
    """
    young = marks.where(F.col("ts") > as_of - F.expr(f"interval {days} days")).select(key)
    open_, done = still_to_do(targets, young, key), None
    while True:
        got = job(open_ if done is None else still_to_do(open_, done, key))
        done = got if done is None else done.unionByName(got)
        if not got.where("found").limit(1).count():
            return done


def refresh_points(points: DataFrame, **feeds: DataFrame) -> DataFrame:
    """Map points (source, item_key, ...) with the values of their feed's rows (item_key, ...), where it still has one.

    A value that the feed has lost is lost here too; positions stay as they are.
    """
    cols = [c for c in next(iter(feeds.values())).columns if c != "item_key"]
    now = two_feeds(*feeds.items()).select("source", "item_key", F.struct(*cols).alias("now"))
    value = lambda c: F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
    return points.join(now, ["source", "item_key"], "left").select(*(value(c) for c in points.columns))


def without_zone(lots: DataFrame, points: DataFrame, source: str) -> DataFrame:
    """Lots (item_key, zone) whose zone isn't known, with their position."""
    at = points.where((F.col("source") == source) & F.col("lat").isNotNull()).select("item_key", "lat", "lng")
    return lots.where("zone is null").select("item_key").join(at, "item_key")


def matched_unsynced(matches: DataFrame, lots: DataFrame) -> DataFrame:
    """Lots (item_key, address, synced_at) that are matched with a complex but weren't collected yet."""
    return lots.where("synced_at is null").select("item_key", "address").join(matches.where("status = 'matched'").select("item_key"), "item_key")


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A sample of n rows that a seed fixes, whatever the partitioning: the first by checksum of seed and key."""
    return rows.orderBy(F.crc32(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def part_of(key: Column, parts: int) -> Column:
    """Part of a stable split, by the key's checksum."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)).cast("int")


def months_back(as_of: Column, n: int) -> Column:
    """The last n months as YYYYMM, newest first."""
    first = F.trunc(as_of, "month")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_format(F.add_months(first, -i), "yyyyMM"))


def running_balance(ledger: DataFrame, owner: str, order: str, amount: str) -> DataFrame:
    """Balance after each entry, and whether it fell below zero."""
    from pyspark.sql import Window as W

    w = W.partitionBy(owner).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return ledger.withColumn("balance", F.sum(amount).over(w)).withColumn("overdrawn", F.col("balance") < 0)


def paid_until(payments: DataFrame, owner: str) -> DataFrame:
    """Fold of payments (day, months) in order: until = later of the day and the current end, plus 30 days a month."""
    ordered = F.array_sort(F.collect_list(F.struct("day", "seq", "months")))
    end = F.aggregate(ordered, F.lit(None).cast("date"), lambda a, p: F.date_add(F.greatest(a, p["day"]), p["months"] * 30))
    return payments.groupBy(owner).agg(F.count("*").alias("payments"), end.alias("until"))


def two_feeds(*feeds: tuple[str, DataFrame]) -> DataFrame:
    """Feeds of one schema in one table, each row with its source."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("source", F.lit(name)) for name, df in feeds])
