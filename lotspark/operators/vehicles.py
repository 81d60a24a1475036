"""Vehicles: purchase grade, used-car ads and reviews of the same model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar as S

#: Class words, which name no model; in lower case.
GENERIC = (
    "suv", "rv", "승용", "승용차", "승용자동차", "승합", "승합차", "승합자동차",
    "화물", "화물차", "화물자동차", "특수", "특수자동차", "자동차", "중기", "건설기계",
    "세단", "해치백", "쿠페", "왜건", "밴", "경형", "소형", "중형", "대형",
    "지게차", "굴삭기", "트럭", "버스", "덤프", "탱크로리",
)

#: Bits of the table of words that vehicles have, and years of a span.
WORD_BITS, SPAN = 1 << 14, 6


def purchase_grade(v: DataFrame, year: Column, tolerance: int = 9999, worst_count: int = 5, worst_damage: int = 6_000_000) -> DataFrame:
    """id, allowed (km), ok and reasons; ok is null if neither age and mileage nor damage is known.

    ``v``: id, model_year, mileage, accidents_self, accidents_other, damage, note.
    """
    known = (F.col("model_year") > 0) & (F.col("mileage") >= 0)
    age = F.greatest(F.lit(0), year - F.col("model_year"))
    allowed = F.when(known, age * F.when(age <= 5, 14000).otherwise(13000) + tolerance)
    broken = lambda w: F.coalesce(F.col("note").contains(w) & ~F.col("note").rlike(w + r"\s*(?:흔적\s*)?없"), F.lit(False))
    any_broken = broken("파손") | broken("누유")
    counted = F.col("accidents_self").isNotNull() | F.col("accidents_other").isNotNull()
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    why = F.array_compact(F.array(
        F.when(any_broken, "damage"), F.when(known & (F.col("mileage") > allowed), "mileage"),
        F.when(known & counted & (n("accidents_self") + n("accidents_other") > worst_count), "accidents"), F.when(known & counted & (n("damage") >= worst_damage), "repair"),
    ))
    return v.select("id", allowed.cast("long").alias("allowed"), F.when(F.coalesce(known, F.lit(False)) | any_broken, F.size(why) == 0).alias("ok"), F.array_join(why, ",").alias("reasons"))


def fuel_group(text: Column) -> Column:
    t = F.lower(F.regexp_replace(text, r"\s+", ""))
    petrol, diesel = t.rlike("가솔린|휘발유"), t.rlike("디젤|경유")
    return F.when(t.contains("하이브리드") | (t.contains("전기") & (petrol | diesel)), "hybrid").when(t.isin("전기", "ev"), "electric").when(t.rlike("lpg|엘피지|엘피아이"), "lpg").when(diesel, "diesel").when(petrol, "petrol")


def match_ads(targets: DataFrame, ads: DataFrame, cheapest: int = 300, kept: int = 60, km: int = 5000, litre_tol: float = 0.1) -> DataFrame:
    """id, ads, mean_price, relaxed: the cheapest ads of a vehicle's model.

    A model term must stand alone in an ad's text: ads are cut into words and
    joined on them. Year within one, mileage within ``km``. Fuel is strict; a
    vehicle without any ad of its fuel takes all. Of the 300 cheapest, those whose
    badge names another engine size are dropped and 60 kept. Vehicles whose only
    terms are class words match nothing.

    Vehicles that agree in all but the engine meet the ads once, and where they meet
    ads only the cheapest 300 go on, so no pair of a vehicle and an ad is shuffled. Rows of one
    id are one vehicle, with the smallest of their engine sizes.

    ``targets``: id, terms (array), year, fuel, mileage, litre; ``ads``: ad, text,
    year, fuel, mileage, price.
    """
    spark = targets.sparkSession
    named = targets.where(~F.forall("terms", lambda x: F.lower(x).isin(*GENERIC)) & F.col("year").isNotNull() & F.col("mileage").isNotNull())
    looks = named.select("id", "litre", "fuel", "year", "mileage", F.array_sort(F.array_distinct(F.transform("terms", F.lower))).alias("terms"))
    looks = looks.withColumn("look", F.xxhash64("terms", "year", "mileage", F.coalesce("fuel", F.lit("?"))))
    own = looks.groupBy("id").agg(F.array_sort(F.collect_set("look")).alias("looks"), F.min("litre").alias("litre")).withColumn("alike", F.xxhash64("looks"))
    each = looks.select("look", "terms", "year", "mileage", "fuel").distinct()
    t = own.select("alike", "looks").distinct().select("alike", F.explode("looks").alias("look")).join(each, "look").withColumn("word", F.explode("terms"))
    # of an ad's words only those go on that some vehicle may have, by a table of bits of fixed size
    bit = lambda w: F.pmod(F.xxhash64(w), F.lit(WORD_BITS))
    asked = named.select(F.explode(F.transform("terms", lambda w: bit(F.lower(w)))).alias("id")).distinct().withColumn("hit", F.lit(True))
    bits = spark.range(WORD_BITS).join(asked, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("bits")).select(F.col("bits.hit").alias("bits"))
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[^0-9a-z가-힣]+")), lambda w: F.get("bits", bit(w).cast("int")))
    low, high = F.greatest(F.lit(0), F.col("mileage") - km), F.col("mileage") + km
    # a target stands in the one or two spans of years and stretches of mileage that its range touches
    span, stretch = (lambda x: F.floor(x / SPAN)), (lambda x: F.floor(x / (2 * km)))
    t = t.select("alike", "fuel", "word", F.col("year").alias("t_year"), low.alias("low"), high.alias("high"), F.explode(F.sequence(span(F.col("year") - 1), span(F.col("year") + 1))).alias("span"))
    t = t.withColumn("stretch", F.explode(F.sequence(stretch(F.col("low")), stretch(F.col("high")))))
    a = ads.crossJoin(F.broadcast(bits)).select("ad", S.litres(F.col("text")).alias("sizes"), F.col("fuel").alias("a_fuel"), F.col("mileage").alias("a_km"), "price", "year", span(F.col("year")).alias("span"), stretch(F.col("mileage")).alias("stretch"), F.explode(words).alias("word"))
    place = ["word", "span", "stretch"]
    pairs = t.join(a, place).where("a_km between low and high and year between t_year - 1 and t_year + 1").select(*place, "alike", "fuel", "ad", "sizes", "a_fuel", "price")
    same = F.coalesce(F.col("fuel") == F.col("a_fuel"), F.lit(False)).cast("int")
    here = W.partitionBy(*place, "alike")
    pairs = pairs.withColumn("same", same).withColumn("strict", F.max("same").over(here)).where("same = 1 or strict = 0")
    cheap = [F.col("price").asc_nulls_last(), "ad"]
    # equal rows have one rank, so the ranks up to 300 hold the cheapest 300 different ones
    some = pairs.withColumn("n", F.dense_rank().over(here.orderBy(*cheap, "sizes", "a_fuel", "fuel"))).where(F.col("n") <= cheapest)
    all_of = W.partitionBy("alike")
    some = some.select("alike", "fuel", "ad", "sizes", "a_fuel", "price", "same").repartition("alike").distinct().withColumn("strict", F.max("same").over(all_of)).where("same = 1 or strict = 0")
    first = some.withColumn("n", F.row_number().over(all_of.orderBy(*cheap))).where(F.col("n") <= cheapest)
    top = first.groupBy("alike").agg(F.array_sort(F.collect_list(F.struct("n", "price", "sizes"))).alias("top"), (F.max("fuel").isNotNull() & (F.max("strict") == 0)).alias("relaxed"))
    fits = lambda x: F.col("litre").isNull() | (F.size(x["sizes"]) == 0) | F.exists(x["sizes"], lambda y: F.abs(y - F.col("litre")) <= litre_tol + 1e-9)
    kept_ = own.select("alike", "litre").distinct().join(top, "alike").withColumn("last", F.slice(F.filter("top", fits), 1, kept)).where("size(last) > 0")
    known = F.filter(F.transform("last", lambda x: F.nullif(x["price"], F.lit(0))), lambda p: p.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, p: s + p) / F.size(known))
    per = kept_.select("alike", "litre", F.size("last").cast("long").alias("ads"), F.bround(mean, 0).cast("long").alias("mean_price"), "relaxed")
    o, p = own.select("id", "alike", "litre").alias("o"), per.alias("p")
    return o.join(p, (F.col("o.alike") == F.col("p.alike")) & F.col("o.litre").eqNullSafe(F.col("p.litre"))).select("id", "ads", "mean_price", "relaxed")


def best_reviews(targets: DataFrame, reviews: DataFrame, others: int = 5) -> DataFrame:
    """id, review, others: the review nearest in year, then of the same fuel, then of the longest model name.

    ``targets``: id, word, year, fuel; ``reviews``: review, word, year, fuel, model.
    """
    r = reviews.select("review", "word", F.col("year").alias("r_year"), F.col("fuel").alias("r_fuel"), F.length("model").alias("n"))
    # alike reviews keep their order for every vehicle, and alike vehicles get the same reviews
    alike = W.partitionBy("word", "r_year", "r_fuel").orderBy(F.col("n").desc(), "review")
    r = r.withColumn("alike", F.row_number().over(alike)).where(F.col("alike") <= others + 1).drop("alike")
    kinds = targets.select("word", "year", "fuel").distinct().withColumn("id", F.struct("word", "year", "fuel"))
    gap = F.coalesce(F.abs(F.col("year") - F.col("r_year")), F.lit(99))
    order = W.partitionBy("id").orderBy(gap, F.when(F.col("fuel") == F.col("r_fuel"), 0).otherwise(1), F.col("n").desc(), "review")
    ranked = kinds.join(r, "word").withColumn("place", F.row_number().over(order)).where(F.col("place") <= others + 1)
    best = ranked.groupBy("id").agg(F.max(F.when(F.col("place") == 1, F.col("review"))).alias("review"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") > 1, F.struct("place", "review")))), lambda s: s["review"].cast("string")), ",").alias("others"))
    own = lambda c: F.col(f"t.{c}").eqNullSafe(F.col(f"b.id.{c}"))
    return targets.alias("t").join(best.alias("b"), own("word") & own("year") & own("fuel")).select("t.id", "review", "others")
