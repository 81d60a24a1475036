"""Comparable past sales of a lot and what they make it worth.

Interval joins as equi-joins on buckets: a case is keyed by its own bucket of
area (or grid cell), a target by its bucket and the neighbours, so a popular
building is spread over its areas and floors instead of meeting in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import distance_m
from .geo import METRES_PER_DEGREE
from .ranking import medians

YEARS = 3
#: Degrees north or south beyond which no lot is looked for.
MAX_LAT = 60.0


def same_building(targets: DataFrame, cases: DataFrame, area_tol: float = 6.0, price_tol: int = 25_000_000) -> DataFrame:
    """Pairs (target, case, rate, sale_price) of one building.

    Both: key, building, area, appraisal, bracket (floor bracket), day; cases also
    rate and sale_price. Area and appraisal within the tolerances, equal brackets,
    day within the three years up to the target's. Nulls match nothing.
    """
    bucket, step = (lambda c: F.floor(c / area_tol)), (lambda c: F.floor(c / price_tol))
    around = lambda c: F.sequence(c - 1, c + 1)
    # a building's name is compared once its hash, floors, area and price fit
    t = targets.dropDuplicates(["key"]).select(F.col("key").alias("target"), F.xxhash64("building").alias("hash"), F.col("building").alias("t_building"), "bracket", F.col("area").alias("t_area"), F.col("appraisal").alias("t_appraisal"), F.col("day").alias("t_day"), F.explode(around(bucket(F.col("area")))).alias("cell")).withColumn("step", F.explode(around(step(F.col("t_appraisal")))))
    c = cases.where("sale_price > 0 and appraisal is not null and rate is not null").dropDuplicates(["key"]).select(F.col("key").alias("case"), F.xxhash64("building").alias("hash"), "building", "bracket", "area", "appraisal", "day", "rate", "sale_price", bucket(F.col("area")).alias("cell"), step(F.col("appraisal")).alias("step"))
    near = (F.col("building") == F.col("t_building")) & (F.abs(F.col("area") - F.col("t_area")) <= area_tol) & (F.abs(F.col("appraisal") - F.col("t_appraisal")) <= price_tol) & F.col("day").between(F.add_months("t_day", -12 * YEARS), F.col("t_day")) & (F.col("case") != F.col("target"))
    return t.join(c, ["hash", "bracket", "cell", "step"]).where(near).select("target", "case", "rate", "sale_price")


def within_radius(targets: DataFrame, cases: DataFrame, radius_m: float = 1000.0, area_tol: float = 6.0, price_tol: int = 15_000_000, floor_tol: int = 1) -> DataFrame:
    """Pairs as of ``same_building``, but within a radius and by floors; both also: lat, lng, floor.

    Places are squares three times as wide as the radius, by stretches of price and floor
    twice as wide as their tolerances: a target stands in those that its ranges touch,
    a case in its own. There rows hold hashes of their keys, which ``expected_bid`` looks up.
    """
    high = 3 * radius_m / METRES_PER_DEGREE
    there = F.when(F.abs("lat") > MAX_LAT, F.raise_error(F.lit(f"a latitude beyond {MAX_LAT}")).cast("double")).otherwise(F.col("lat"))
    wide = lambda cy: F.lit(high) / F.cos(F.radians(F.greatest(F.abs(cy), F.abs(cy + 1)) * high))
    step, storey = (lambda x: F.floor(x / (2 * price_tol))), (lambda x: F.floor(x / (2 * max(floor_tol, 1))))
    span = lambda f, x, d: F.explode(F.sequence(f(x - d), f(x + d)))
    own = ["area", "appraisal", "floor", "day", "lat", "lng"]
    known = F.forall(F.array(*(F.col(x).isNotNull() for x in own)), lambda x: x)
    rows = lambda df, *more: df.withColumn("lat", there).where(known).select(F.xxhash64("key").alias("h"), *own, *more)

    named = targets.dropDuplicates(["key"])
    reach = F.lit(radius_m * 1.001 / METRES_PER_DEGREE)
    t = rows(named).withColumn("cy", span(lambda y: F.floor(y / high), F.col("lat"), reach))
    t = t.withColumn("cx", span(lambda x: F.floor(x / wide(F.col("cy"))), F.col("lng"), reach / F.cos(F.radians(F.abs("lat") + reach))))
    t = t.withColumn("step", span(step, F.col("appraisal"), F.lit(price_tol))).withColumn("storey", span(storey, F.col("floor"), F.lit(floor_tol)))
    c = rows(cases.where("sale_price > 0 and appraisal is not null and rate is not null").dropDuplicates(["key"]), "rate", "sale_price").withColumn("cy", F.floor(F.col("lat") / high))
    c = c.withColumn("cx", F.floor(F.col("lng") / wide(F.col("cy")))).withColumn("step", step(F.col("appraisal"))).withColumn("storey", storey(F.col("floor")))
    place = F.xxhash64("cy", "cx", "step", "storey").alias("place")
    a, b = t.select(place, "h", *own).alias("a"), c.select(place, "h", *own, "rate", "sale_price").alias("b")
    x, y = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    near = (F.abs(y("area") - x("area")) <= area_tol) & (F.abs(y("appraisal") - x("appraisal")) <= price_tol) & (F.abs(y("floor") - x("floor")) <= floor_tol) & y("day").between(F.add_months(x("day"), -12 * YEARS), x("day")) & (x("h") != y("h"))
    pairs = a.join(b.hint("merge"), (x("place") == y("place")) & near & (distance_m(x("lat"), x("lng"), y("lat"), y("lng")) <= radius_m))
    return pairs.select(x("h").alias("target"), y("h").alias("case"), y("rate").alias("rate"), y("sale_price").alias("sale_price"))


def expected_bid(targets: DataFrame, pairs: DataFrame, keep: Column, hashed: bool = False) -> DataFrame:
    """Per target: available, expected_bid (half-even mean), cases and excluded (pairs that ``keep`` rejects).

    ``pairs`` holds a pair once, as the joins above give them out. With ``hashed``, its
    targets are hashes of keys. Targets without a case stay, unavailable.
    """
    sums = pairs.groupBy("target").agg(F.count_if(keep).alias("cases"), F.count_if(~keep).alias("excluded"), F.bround(F.avg(F.when(keep, F.col("sale_price"))), 0).cast("long").alias("expected_bid"))
    by = F.xxhash64("key") if hashed else F.col("key")
    return targets.select(F.col("key").alias("target"), by.alias("by")).join(sums.withColumnRenamed("target", "by"), "by", "left").select("target", F.coalesce(F.col("cases") > 0, F.lit(False)).alias("available"), "expected_bid", F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("excluded", F.lit(0)).alias("excluded"))


def vehicle_median(targets: DataFrame, cases: DataFrame, as_of: Column, year_tol: int = 1, mileage_tol: float = 0.2, days: int = 3 * 365, least: int = 2) -> DataFrame:
    """target, cases, expected_bid: the median price, cut to whole won, of at least two cases.

    Cases are of the target's maker and model, alike in year and mileage, sold lately
    or on an unknown day, and not of its id. Both: id, maker, model, model_year,
    mileage; cases also price and sell_day.

    Targets that agree in all four have the same cases, so the prices of such a kind
    are counted once, equal ones in one row. Rows of one id are one target; one that
    a case has the id of counts by itself.
    """
    own = ["maker", "model"]
    t = targets.where("model_year > 0 and mileage > 0 and model <> '' and maker is not null and id is not null")
    c = cases.where("price > 0 and mileage > 0 and model_year is not null and id is not null").where(F.col("sell_day").isNull() | (F.col("sell_day") >= F.date_sub(as_of, days)))
    met = lambda x, y: (F.abs(y["model_year"] - x["model_year"]) <= year_tol) & y["mileage"].between(x["mileage"] * (1 - mileage_tol), x["mileage"] * (1 + mileage_tol))
    look = F.struct(*own, "model_year", "mileage")
    ids = t.select("id", look.alias("t")).unionByName(c.select("id", look.alias("c")), allowMissingColumns=True)
    ids = ids.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.collect_set("c").alias("cs")).where("size(ts) > 0")
    itself = F.exists("ts", lambda x: F.exists("cs", lambda y: (x["maker"] == y["maker"]) & (x["model"] == y["model"]) & met(x, y)))
    rows = ids.select(F.col("id").alias("target"), "ts", F.when(itself, F.col("id")).alias("but")).withColumn("alike", F.xxhash64("ts", F.col("but").isNotNull(), F.coalesce("but", F.lit(0))))
    looks = rows.select("alike", "ts", "but").distinct().select("alike", "but", F.explode("ts").alias("t")).groupBy("alike", "but", "t").agg(F.count("*").alias("times"))
    size = lambda x: F.floor(F.ln(x) / math.log((1 + mileage_tol) / (1 - mileage_tol)))
    low, high = F.col("t.mileage") * (1 - mileage_tol), F.col("t.mileage") * (1 + mileage_tol)
    asked = looks.select("*", "t.maker", "t.model", F.explode(F.sequence(F.col("t.model_year") - year_tol, F.col("t.model_year") + year_tol)).alias("model_year")).withColumn("size", F.explode(F.sequence(size(low), size(high))))
    near = F.col("mileage").between(low, high)
    place = [*own, "model_year", "size"]
    few = c.groupBy(*own, "model_year", "mileage", "price").agg(F.count("*").alias("n")).withColumn("size", size(F.col("mileage")))
    all_of = asked.where("but is null").join(few, place).where(near).select("alike", "price", (F.col("n") * F.col("times")).alias("n"))
    few = c.select(F.col("id").alias("case"), *own, "model_year", "mileage", "price", size(F.col("mileage")).alias("size"))
    others = asked.where("but is not null").join(few, place).where(near & (F.col("case") != F.col("but"))).select("alike", "price", F.col("times").alias("n"))
    found = medians(all_of.unionByName(others), ["alike"], "price", weight="n").where(F.col("n") >= least)
    return rows.select("target", "alike").join(found, "alike").select("target", F.col("n").alias("cases"), F.floor("median").cast("long").alias("expected_bid"))
