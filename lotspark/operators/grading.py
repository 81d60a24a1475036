"""Rule tables as column expressions: grades, resale profit, building and market rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOOD = 30_000_000

#: Income up to, rate in percent, progressive deduction.
INCOME_TAX = [(14_000_000, 6, 0), (50_000_000, 15, 1_260_000), (88_000_000, 24, 5_760_000), (150_000_000, 35, 15_440_000), (300_000_000, 38, 19_940_000), (500_000_000, 40, 25_940_000), (1_000_000_000, 42, 35_940_000)]
TOP_TAX = (45, 65_940_000)
#: Households that a kind of shop needs, and whether it needs a school near.
SHOPS = [(700, "편의점", False), (700, "미용실", False), (700, "세탁소", False), (700, "부동산", False), (700, "교습소", True), (2500, "빵집", False), (2500, "학원", True), (2500, "의원", True), (2500, "일반음식점", False), (2500, "근린상권 형성", False), (10000, "다이소", False), (10000, "올리브영", False)]
RENTAL = r"(국민임대|공공임대|행복주택|영구임대|장기전세|LH|SH|매입임대|전세임대)"


def _known(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(0))


def buy_grade(df: DataFrame) -> DataFrame:
    """``df`` (price, expected, minimum) with base, profit and grade; rows without a base to compare are dropped.

    Zero is unknown. Base is the larger of expected and minimum bid.
    """
    base = F.greatest(_known("expected"), _known("minimum"))
    price = _known("price")
    grade = F.when(price.isNull() | (base > price), "ban").when(price - base >= GOOD, "good").otherwise("review")
    return df.withColumn("base", base).withColumn("profit", price - base).withColumn("grade", grade).where(price.isNull() | F.col("base").isNotNull())


def fallback_grade(df: DataFrame) -> DataFrame:
    """As ``buy_grade`` for rows without a price, from the latest trade (recent): review or ban."""
    base = F.greatest(_known("expected"), _known("minimum"))
    profit = _known("recent") - base
    return df.where(F.col("price").isNull()).withColumn("profit", profit).withColumn("grade", F.when(profit >= GOOD, "review").otherwise("ban"))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def short_sale(df: DataFrame, months: int = 3, rate: float = 5.0, early: float = 0.5, legal: int = 200_000, of_appraisal: float = 60, of_bid: float = 80) -> DataFrame:
    """``df`` (bid, sell, appraisal, deposit, area) with the costs and the net profit of a quick resale, in whole won.

    Acquisition tax runs from 1 to 3 % between six and nine hundred million; the
    loan is the smaller of two shares; income tax is progressive.
    """
    bid, diff = F.col("bid").cast("double"), F.col("sell").cast("double") - F.col("bid")
    eok = bid / 1e8
    base = half_even(F.when(eok <= 6, 1.0).when(eok <= 9, eok * 2 / 3 - 3).otherwise(3.0) * 100) / 100
    acq = half_even(bid * base / 100)
    over = F.coalesce(F.col("area") > 85, F.lit(False))
    tax = acq + F.when(over, half_even(bid * 0.2 / 100)).otherwise(0) + half_even(acq * 0.1) + F.when(bid <= 1e8, 0).when(bid <= 1e9, 150000).otherwise(350000)
    by_a, by_b = F.col("appraisal") * of_appraisal / 100, bid * of_bid / 100
    loan = F.when((F.col("appraisal") > 0) & (by_a < by_b), by_a).otherwise(by_b)
    step = df.withColumn("diff", diff).withColumn("acq", tax).withColumn("loan", loan)
    income = F.greatest(F.lit(0.0), F.col("diff"))
    pct, ded = F.lit(float(TOP_TAX[0])), F.lit(float(TOP_TAX[1]))
    for cap, p, d in reversed(INCOME_TAX):
        pct, ded = F.when(income <= cap, float(p)).otherwise(pct), F.when(income <= cap, float(d)).otherwise(ded)
    gross = income * pct / 100
    net_tax = F.greatest(F.lit(0.0), gross - ded)
    interest = F.col("loan") * early / 100 + months * (F.col("loan") * rate / 100 / 12)
    costs = interest + F.col("acq") + legal
    capital = F.col("bid") - F.col("loan")
    net = F.col("diff") - costs - net_tax
    return step.select(
        *df.columns, F.col("diff").cast("long").alias("diff"), half_even(F.col("loan")).cast("long").alias("loan"), F.col("acq").cast("long").alias("acq"), half_even(net_tax).cast("long").alias("tax"), half_even(net).cast("long").alias("net"),
        half_even(F.col("deposit") + (capital - F.col("deposit")) + costs + gross).cast("long").alias("total"), F.when(capital > 0, half_even(net / capital * 100, 1)).alias("yield"),
    )


def multi_family(df: DataFrame) -> DataFrame:
    """``df`` (area, units, floors) with ok_area, ok_units, ok_floors (null: to be checked) and verdict."""
    ok = [("ok_area", F.col("area") <= 660), ("ok_units", F.when(F.col("units") > 0, F.col("units") <= 19)), ("ok_floors", F.when((F.col("floors") > 0) & (F.col("floors") <= 3), True))]
    out = df.withColumns(dict(ok))
    fails = ~F.coalesce("ok_area", F.lit(True)) | ~F.coalesce("ok_units", F.lit(True))
    return out.withColumn("verdict", F.when(fails, "fail").when(F.col("ok_area") & F.col("ok_units") & F.col("ok_floors"), "pass").otherwise("check"))


def debt_and_demand(df: DataFrame) -> DataFrame:
    """``df`` (appraisal, deposits, claims, units, demanding, tenants, text) with debt ratio, demand level and violation flag."""
    total = F.coalesce("deposits", F.lit(0)) + F.coalesce("claims", F.lit(0))
    ratio = F.when((F.col("appraisal") > 0) & (total > 0), half_even(total / F.col("appraisal") * 100).cast("long"))
    share = F.when(F.col("units") > 0, F.least(F.lit(100), half_even(F.greatest("demanding", "tenants") / F.col("units") * 100).cast("long")))
    return df.select("*", ratio.alias("debt_ratio"), F.when(ratio.isNotNull(), total >= F.col("appraisal")).alias("debt_good"), share.alias("share"), F.when(share >= 60, "good").when(share >= 30, "mid").when(share.isNotNull(), "low").alias("demand"), F.coalesce(F.col("text").rlike("위반 ?건축물"), F.lit(False)).alias("violation"))


def household_demand(near: DataFrame) -> DataFrame:
    """Per shop out of (shop, households, name): apartment and land households, rentals, and the base with rentals at half."""
    hh, land, rent = F.col("households"), F.col("name") == "택지", F.col("name").rlike(RENTAL)
    s = lambda c: F.sum(F.when(c, hh).otherwise(0))
    g = near.groupBy("shop").agg(s(~land).alias("apartments"), s(land).alias("land"), s(~land & rent).alias("rentals"))
    return g.withColumn("base", F.greatest(F.lit(0), F.col("apartments") + F.col("land") - F.floor(F.col("rentals") * 0.5)).cast("long"))


def feasible_shops(df: DataFrame) -> DataFrame:
    """``df`` (shop, base, school): one row per shop and kind with state ok, edge or no.

    The kinds are a fixed list of a dozen, exploded in place.
    """
    kinds = F.array(*(F.struct(F.lit(t).alias("need"), F.lit(k).alias("kind"), F.lit(s).alias("school")) for t, k, s in SHOPS))
    e = df.withColumn("k", F.explode(kinds))
    able = ~F.col("k.school") | F.col("school")
    return e.select("shop", F.col("k.kind").alias("kind"), F.when((F.col("base") >= F.col("k.need")) & able, "ok").when((F.col("base") >= F.col("k.need") * 0.8) & able, "edge").otherwise("no").alias("state"))


def rent_hint(base: Column, floor: Column) -> Column:
    """Rent per pyeong in ten thousand won."""
    tier = F.when(base >= 10000, 10.0).when(base >= 5000, 8.0).when(base >= 2500, 6.0).when(base >= 1500, 5.0).when(base >= 700, 4.0).otherwise(3.0)
    return half_even(tier * F.when(floor.isNull(), 0.5).when(floor == 1, 1.0).when(floor == 2, 0.5).otherwise(0.4), 1)


def licence_zone(school_m: Column) -> Column:
    return F.when(school_m <= 50, "absolute").when(school_m <= 200, "relative").otherwise("none")


def shop_warnings(df: DataFrame) -> DataFrame:
    """``df`` (usage, homes_around, floor, base, rental_pct) with ``warnings``."""
    w = F.array_compact(F.array(
        F.when(F.col("usage").rlike("위락|유흥|숙박|단란") & F.col("homes_around"), "amusement"), F.when((F.col("floor") == 1) & (F.col("base") < 700), "ground_floor"),
        F.when(F.col("rental_pct") >= 25, "rentals"), F.when(F.col("base") < 2500, "no_centre"),
    ))
    return df.withColumn("warnings", F.array_join(w, ","))


def merged_brief(df: DataFrame) -> DataFrame:
    """Register values first, appraisal second; unit numbers outside 1 to 9999 are dropped. Columns r_* and a_*."""
    fit = lambda c: F.when(F.col(c).between(1, 9999), F.col(c))
    return df.withColumn("units", F.coalesce(fit("r_units"), fit("a_units"))).withColumn("floors", F.coalesce(F.nullif("r_floors", F.lit(0)), F.nullif("a_floors", F.lit(0))))


def majority_purpose(rows: DataFrame) -> DataFrame:
    """parcel, rows, homes, is_home: does a strict majority of a parcel's building rows serve homes?"""
    home = F.coalesce(F.col("purpose").rlike("주택|아파트|빌라"), F.lit(False))
    return rows.groupBy("parcel").agg(F.count("*").alias("rows"), F.count_if(home).alias("homes")).withColumn("is_home", F.col("homes") > F.col("rows") - F.col("homes"))


def parcel_class(df: DataFrame) -> DataFrame:
    """Class of a parcel by the first flag that holds: own, apartment, school, home, shop, else none."""
    names = ["own", "apartment", "school", "home", "shop"]
    out = F.lit("none")
    for n in reversed(names):
        out = F.when(F.coalesce(F.col(n), F.lit(False)), n).otherwise(out)
    return df.withColumn("class", out)


def parcel_kind(lot_text: Column) -> Column:
    """Land category: the last Hangul character of a lot text; roads, rivers and the like are null."""
    last = F.regexp_extract(lot_text, "([가-힣])[^가-힣]*$", 1)
    return F.when((last != "") & ~last.isin("도", "천", "구", "제", "묘", "철"), last)


def households_of_area(area: Column) -> Column:
    """1,300 per 50,000 square metres, for plots of 2,000 and more."""
    return F.when(area >= 2000, half_even(area / 50000 * 1300).cast("long")).otherwise(0)
