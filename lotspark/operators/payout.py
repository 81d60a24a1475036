"""Distribution of a sale price among small tenants, dated claims and general claims.

Amounts are whole won; products are decimals, as they pass 64 bits. Every step is
a window over a lot's tenants and claims, which are dealt by lot once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed values, in won: region, in force from, largest small deposit, largest preferred amount.
LIMITS = [
    ("seoul", "2018-09-18", 110_000_000, 37_000_000), ("seoul", "2021-05-11", 150_000_000, 50_000_000), ("seoul", "2023-02-21", 165_000_000, 55_000_000),
    ("overconcentration", "2018-09-18", 100_000_000, 34_000_000), ("overconcentration", "2021-05-11", 130_000_000, 43_000_000), ("overconcentration", "2023-02-21", 145_000_000, 48_000_000),
    ("metro", "2018-09-18", 60_000_000, 20_000_000), ("metro", "2021-05-11", 70_000_000, 23_000_000), ("metro", "2023-02-21", 85_000_000, 28_000_000),
    ("other", "2018-09-18", 50_000_000, 17_000_000), ("other", "2021-05-11", 60_000_000, 20_000_000), ("other", "2023-02-21", 75_000_000, 25_000_000),
]

#: Kind of right: stage in which it is paid.
STAGES = {"mortgage": "priority", "jeonse": "priority", "prov_seizure": "general", "seizure": "general"}


def limit_table(spark: SparkSession, limits: list[tuple] = LIMITS) -> DataFrame:
    """region, from, until (null: open), max_deposit, max_priority; the first row of a region is open to the past."""
    rows = spark.createDataFrame([(r, dt.date.fromisoformat(d), a, b) for r, d, a, b in limits], "region string, eff date, max_deposit long, max_priority long")
    w = W.partitionBy("region").orderBy("eff")
    return rows.select("region", F.when(F.lag("eff").over(w).isNotNull(), F.col("eff")).alias("eff_from"), F.lead("eff").over(w).alias("eff_until"), "max_deposit", "max_priority")


def with_limits(lots: DataFrame, limits: DataFrame) -> DataFrame:
    """``lots`` (region, base_date) with the limits in force on base_date; an unknown date gets the oldest."""
    b = F.broadcast(limits)  # a dozen rows by law
    day = F.coalesce(lots["base_date"], F.lit("0001-01-01").cast("date"))
    hit = (lots["region"] == b["region"]) & (b["eff_from"].isNull() | (day >= b["eff_from"])) & (b["eff_until"].isNull() | (day < b["eff_until"]))
    return lots.join(b, hit, "left").select(lots["*"], "max_deposit", "max_priority")


def claims_of(rights: DataFrame, tenants: DataFrame) -> DataFrame:
    """Claims (lot, seq, stage, amount, priority_date, tenant) out of rights and tenants.

    Mortgages and lease rights rank by date, seizures share what is left; a tenant
    who demands payment and has a fixed date ranks by the later of that date and the
    day after moving in. Rights come before tenants of the same date.
    """
    stages = F.create_map(*(F.lit(x) for kind_stage in STAGES.items() for x in kind_stage))
    r = rights.withColumn("stage", stages[F.col("kind")]).where("stage is not null").select(
        "lot", F.col("seq").cast("long"), "stage", "amount", F.when(F.col("stage") == "priority", F.col("reg_date")).alias("priority_date"), F.lit(None).cast("long").alias("tenant"),
    )
    t = tenants.where(F.coalesce("demanded", F.lit(False)) & F.col("fixed").isNotNull() & F.col("move_in").isNotNull()).select(
        "lot", (F.col("seq") + 1_000_000).cast("long").alias("seq"), F.lit("priority").alias("stage"), F.col("deposit").alias("amount"),
        F.greatest("fixed", F.date_add("move_in", 1)).alias("priority_date"), F.col("seq").cast("long").alias("tenant"),
    )
    return r.unionByName(t)


def distribute(lots: DataFrame, tenants: DataFrame, claims: DataFrame, limits: DataFrame, shares: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(payouts, recoveries, lots).

    ``lots``: lot, fund, region, base_date (of the baseline right, or null).
    ``tenants``: lot, seq, move_in, deposit, demanded. ``claims``: as of ``claims_of``.

    payouts: lot, seq, stage (small, priority or general), paid.
    recoveries: lot, seq, received, assumes. lots: lot, fund, paid, leftover, assumed.
    With ``shares``, all of it for each of these percentages of the fund (pct), which
    are worked out where a lot's rows have been dealt to, not dealt by themselves.
    """
    base = with_limits(lots, limits).select("lot", F.lit("lot").alias("row"), "fund", "base_date", "max_deposit", "max_priority")
    owed = tenants.select("lot", F.lit("tenant").alias("row"), F.col("seq").cast("long").alias("seq"), F.col("seq").cast("long").alias("tenant"), "move_in", "deposit", F.coalesce("demanded", F.lit(False)).alias("demanded"))
    asked = claims.select("lot", F.col("stage").alias("row"), "seq", "tenant", "amount", "priority_date")
    # a lot, its tenants and its claims in one table, dealt by lot once; all that follows are windows within a lot,
    # in an order that serves those by lot and by tenant until the claims need their own
    rows = base.unionByName(owed, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True).repartition("lot")
    by = ["lot"]
    if shares:
        by = ["lot", "pct"]
        rows = rows.withColumn("pct", F.explode(F.array(*(F.lit(x).cast("long") for x in shares)))).withColumn("fund", F.floor(F.col("fund") * F.col("pct") / 100).cast("long"))
    rows = rows.sortWithinPartitions(*by, "tenant")
    lot, tenant = W.partitionBy(*by), W.partitionBy(*by, "tenant")
    rows = rows.withColumns({c: F.max(c).over(lot) for c in ("fund", "base_date", "max_deposit", "max_priority")}).where("fund is not null")
    # small tenants, together at most half the fund; beyond it in proportion, rounded down
    share = lambda of, part, total: F.expr(f"cast(cast({of} as decimal(20,0)) * cast({part} as decimal(18,0)) div cast({total} as decimal(20,0)) as bigint)")
    small = F.expr("row = 'tenant' and demanded and move_in is not null and deposit <= max_deposit")
    rows = rows.withColumn("due", F.when(small, F.least("deposit", "max_priority"))).withColumn("total", F.sum("due").over(lot)).withColumn("half", F.floor(F.col("fund") / 2).cast("long"))
    rows = rows.withColumn("small", F.when(F.col("due").isNotNull(), F.when(F.col("total") <= F.col("half"), F.col("due")).otherwise(share("half", "due", "total"))))
    rows = rows.withColumn("rest", F.col("fund") - F.coalesce(F.sum("small").over(lot), F.lit(0)))
    # claims in order of their dates use up the rest; a tenant claims what the first stage left
    had = F.when(F.col("tenant").isNotNull(), F.max("small").over(tenant))
    rows = rows.withColumn("claim", F.when(F.col("row") == "priority", F.greatest(F.lit(0), F.col("amount") - F.coalesce(had, F.lit(0)))))
    order = lot.orderBy(F.col("priority_date").asc_nulls_last(), "seq").rowsBetween(W.unboundedPreceding, -1)
    prior = F.coalesce(F.sum("claim").over(order), F.lit(0))
    rows = rows.withColumn("priority", F.greatest(F.lit(0), F.least(F.col("claim"), F.col("rest") - prior))).withColumn("priority", F.when(F.col("claim").isNotNull(), F.col("priority")))
    # general claims share the remainder in proportion, rounded down
    rows = rows.withColumn("left", F.col("rest") - F.coalesce(F.sum("priority").over(lot), F.lit(0))).withColumn("all", F.sum(F.when(F.col("row") == "general", F.col("amount"))).over(lot))
    rows = rows.withColumn("general", F.when(F.expr("row = 'general' and left > 0 and all > 0"), F.least("amount", share("left", "amount", "all"))))
    rows = rows.withColumn("paid", F.coalesce("small", "priority", "general"))
    paid = rows.where("small is not null or priority > 0 or general is not null")
    payouts = paid.select(*by, "seq", "tenant", F.when(F.col("row") == "tenant", "small").otherwise(F.col("row")).alias("stage"), "paid")
    received = F.when(F.col("tenant").isNotNull(), F.coalesce(F.sum("paid").over(tenant), F.lit(0)))
    senior = F.coalesce(F.date_add("move_in", 1) <= F.col("base_date"), F.lit(False))
    rows = rows.withColumn("received", received).withColumn("assumes", F.when(F.col("row") == "tenant", F.when(senior, F.greatest(F.lit(0), F.col("deposit") - F.col("received"))).otherwise(0)))
    recoveries = rows.where("row = 'tenant'").select(*by, F.col("seq"), "received", "assumes")
    totals = rows.groupBy(*by).agg(F.max("fund").alias("fund"), F.coalesce(F.sum("paid"), F.lit(0)).alias("paid"), F.coalesce(F.sum("assumes"), F.lit(0)).alias("assumed"))
    return payouts, recoveries, totals.select(*by, "fund", "paid", (F.col("fund") - F.col("paid")).alias("leftover"), "assumed")
