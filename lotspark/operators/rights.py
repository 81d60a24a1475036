"""Registered rights and tenants of a lot: baseline, verdicts, assumed amounts, risk.

All steps group or partition by lot, so rights, tenants and verdicts of a lot
stay in one place after the first shuffle. Ties go to the smaller ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CANDIDATES = ("mortgage", "seizure", "prov_seizure", "security", "auction_start")
SURVIVORS = ("jeonse", "surface", "easement", "lease", "ownership_prov", "injunction", "repurchase")
HIGH_RISK = ("ownership_prov", "injunction")


def is_candidate() -> Column:
    """A money right, or a lease right on the whole building whose holder demands payment."""
    return F.col("kind").isin(*CANDIDATES) | ((F.col("kind") == "jeonse") & F.col("whole") & F.col("demanded"))


def baselines(rights: DataFrame) -> DataFrame:
    """lot, base_date, base_seq: the earliest candidate right of each lot that has one."""
    # no filter before the groups: pushed down, it would work out a derived kind once per mention
    first = F.min(F.when(is_candidate() & F.col("reg_date").isNotNull(), F.struct("reg_date", "seq"))).alias("b")
    return rights.groupBy("lot").agg(first).where("b is not null").select("lot", F.col("b.reg_date").alias("base_date"), F.col("b.seq").alias("base_seq"))


def judge_rights(rights: DataFrame) -> DataFrame:
    """``rights`` (lot, seq, kind, reg_date, amount, whole, demanded, note) with base_date, verdict and reason."""
    lot = W.partitionBy("lot")
    base = F.min(F.when(is_candidate() & F.col("reg_date").isNotNull(), F.struct("reg_date", "seq"))).over(lot)
    r = rights.withColumn("base", base).withColumn("base_date", F.col("base.reg_date"))
    senior = F.col("reg_date") < F.col("base_date")
    demolition = (F.col("kind") == "injunction") & F.coalesce(F.col("note").contains("철거"), F.lit(False))
    rules = [
        (F.col("kind") == "ownership", "소유권", "owner"),
        (F.col("base").isNull(), "인수", "no_baseline"),
        (F.col("seq") == F.col("base.seq"), "말소기준권리", "baseline"),
        (~senior & demolition, "인수", "demolition"),
        (~senior, "소멸", "junior"),
        (F.col("kind").isin(*SURVIVORS), "인수", "senior"),
    ]
    verdict, reason = F.lit("소멸"), F.lit("senior_money")
    for test, v, why in reversed(rules):
        verdict, reason = F.when(test, v).otherwise(verdict), F.when(test, why).otherwise(reason)
    return r.withColumn("verdict", verdict).withColumn("reason", reason).drop("base")


def judge_tenants(tenants: DataFrame, bases: DataFrame) -> DataFrame:
    """``tenants`` (lot, seq, move_in, deposit, demanded) with has_power, assumes and recheck.

    Power begins the day after moving in. Without a baseline every tenant who
    moved in has it.
    """
    t = tenants.join(bases, "lot", "left")
    opposing = F.date_add("move_in", 1)
    power = F.when(F.col("base_date").isNull(), opposing.isNotNull()).otherwise(F.coalesce(opposing <= F.col("base_date"), F.lit(False)))
    demanded = F.coalesce("demanded", F.lit(False))
    return t.withColumn("has_power", power).withColumn("assumes", F.when(power & ~demanded, F.col("deposit")).otherwise(0).cast("bigint")).withColumn("recheck", power & demanded)


def analyse(rights: DataFrame, tenants: DataFrame) -> DataFrame:
    """Per lot: base_date, assumed amount, review flag, warnings and risk (위험, 주의 or 안전)."""
    judged = judge_rights(rights)
    by_right = judged.groupBy("lot").agg(
        F.max("base_date").alias("base_date"), F.sum(F.when(F.col("verdict") == "인수", F.col("amount")).otherwise(0)).alias("assumed"),
        F.max((F.col("verdict") == "인수").cast("int")).alias("takes"), F.max(F.col("kind").isin(*HIGH_RISK).cast("int")).alias("risky"), F.count_if(F.col("kind").isin(*HIGH_RISK)).alias("risky_rights"),
    )
    t = judge_tenants(tenants, by_right.select("lot", "base_date"))
    by_tenant = t.groupBy("lot").agg(F.sum("assumes").alias("deposits"), F.max(F.col("has_power").cast("int")).alias("power"), F.count_if("recheck").alias("rechecks"))
    lots = by_right.join(by_tenant, "lot", "full")
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    review = F.col("base_date").isNull() | (n("risky") == 1) | (n("power") == 1)
    total = n("assumed") + n("deposits")
    return lots.select(
        "lot", "base_date", total.alias("assumed"), review.alias("review"), (n("risky_rights") + n("rechecks") + F.col("base_date").isNull().cast("int")).alias("warnings"),
        F.when((total > 0) | (n("takes") == 1), "위험").when(review, "주의").otherwise("안전").alias("risk"),
    )


def exclusion_rules() -> list[tuple[str, Column]]:
    """Rules of the collection policy; append (reason, column) to extend it."""
    senior = F.col("base_date").isNull() | (F.col("reg_date") < F.col("base_date"))
    return [("senior_ownership_registration", (F.col("kind") == "ownership_prov") & senior)]


def screened(rights: DataFrame, rules: list[tuple[str, Column]] | None = None) -> DataFrame:
    """lot, reasons: why a lot isn't collected; an empty array means it is."""
    judged = judge_rights(rights)
    hits = F.array_compact(F.array(*(F.when(test, why) for why, test in rules or exclusion_rules())))
    return judged.groupBy("lot").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(hits)))).alias("reasons"))


def merged_tenants(tenants: DataFrame) -> DataFrame:
    """One row per (lot, occupant): first known dates by seq, largest deposit, any demand."""
    first = lambda col: F.min_by(col, F.when(F.col(col).isNotNull(), F.col("seq"))).alias(col)
    return tenants.groupBy("lot", "occupant").agg(F.min("seq").alias("seq"), first("move_in"), first("fixed"), F.max("deposit").alias("deposit"), F.bool_or("demanded").alias("demanded"))


def risk_by_crawler(tenants: DataFrame, takes: DataFrame) -> DataFrame:
    """Risk from a site's own tenant verdicts.

    ``tenants``: lot, assume (amount or null), deposit, power, waived, move_in,
    base_date. A waiver removes what it names; moving in before the baseline gives
    power that the site missed, and a deposit with power counts whole if nothing is
    noted. ``takes``: lots with an assumed right.
    """
    power = F.coalesce("power", F.lit(False)) | F.coalesce(F.col("move_in") < F.col("base_date"), F.lit(False))
    kept = F.when(F.col("waived"), 0).otherwise(F.coalesce("assume", F.lit(0)))
    t = tenants.withColumn("power", power).withColumn("sum", F.when((kept == 0) & power & (F.coalesce("deposit", F.lit(0)) > 0), F.col("deposit")).otherwise(kept))
    per = t.groupBy("lot").agg(F.sum("sum").alias("assumed"), F.bool_or(F.col("power") & ~F.col("waived")).alias("power"))
    flag = per.join(takes.select("lot").distinct().withColumn("takes", F.lit(True)), "lot", "left")
    return flag.select("lot", "assumed", F.when((F.col("assumed") > 0) | F.coalesce("takes", F.lit(False)), "위험").when(F.col("power"), "주의").otherwise("안전").alias("risk"))


def live_entries(entries: DataFrame) -> DataFrame:
    """Register entries without the cancelled ones, owners corrected.

    ``entries``: lot, section, rank, action (set, cancel or correct), target (rank
    that an action names), holder. A cancellation hits the same section's rank.
    """
    key = ["lot", "section", "rank"]
    cancelled = entries.where("action = 'cancel'").select("lot", "section", F.col("target").alias("rank")).distinct()
    fixes = entries.where("action = 'correct'").groupBy("lot", "section", F.col("target").alias("rank")).agg(F.max_by("holder", "seq").alias("fixed_holder"))
    return entries.where("action = 'set'").join(cancelled, key, "left_anti").join(fixes, key, "left").withColumn("holder", F.coalesce("fixed_holder", "holder")).drop("fixed_holder", "action", "target")


def liens_by_summary(body: DataFrame, summary: DataFrame) -> DataFrame:
    """Summary liens in place of the body's, holder and amount filled from the body; ownership rows stay.

    Both: lot, seq, kind, reg_date, holder, amount.
    """
    key = ["lot", "kind", "reg_date"]
    fill = body.groupBy(*key).agg(F.min_by("holder", F.when(F.col("holder") != "", F.col("seq"))).alias("h"), F.max_by("amount", F.when(F.col("amount") > 0, F.col("seq"))).alias("m"))
    own = F.coalesce("holder", F.lit("")).isin("", "국") & F.col("h").isNotNull()
    filled = summary.join(fill, key, "left").select(*key, F.when(own, F.col("h")).otherwise(F.coalesce("holder", F.lit(""))).alias("holder"), F.coalesce(F.nullif("amount", F.lit(0)), F.col("m"), F.lit(0)).alias("amount"))
    return body.where("kind = 'ownership'").select(*key, "holder", "amount").union(filled).distinct()
