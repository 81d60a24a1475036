"""Lots against market trades, complexes and asking listings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar as S
from ..functions.helpers import lcs
from ..sources.scratch import saver
from .ranking import medians
from .substrings import containing


def by_key_or_name(lots: DataFrame, trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lots whose town and lot number have trades; the other ones with ``name``, once for each complex that they name.

    ``lots``: lot, sgg, umd, jibun, address, area; ``trades``: sgg, umd, jibun, name.
    Of a lot without trades under its number, the blank-free address contains the
    name, within the district. Names meet addresses by their rarest three letters in
    the district, once per distinct name and address.
    """
    keys = trades.select(*KEY).distinct()
    left = lots.join(keys, KEY, "left_anti").withColumn("flat", F.regexp_replace("address", r"\s+", ""))
    names = trades.select("sgg", "name").where("name <> ''").distinct().withColumn("needle", F.regexp_replace("name", r"\s+", ""))
    met = containing(left.select("sgg", F.col("flat").alias("text")), names, ("sgg",))
    named = left.join(met.withColumnRenamed("text", "flat"), ["sgg", "flat"]).join(names, ["sgg", "needle"])
    return lots.join(keys, KEY, "left_semi"), named.select(*lots.columns, "name")


#: What trades of a complex agree in: town and lot number, or district and name.
KEY, NAME = ["sgg", "umd", "jibun"], ["sgg", "name"]


def same_complex(lots: DataFrame, trades: DataFrame) -> DataFrame:
    """Lots with the trades of their complex, as of ``by_key_or_name``: a row for each pair, so only for few lots."""
    keyed, named = by_key_or_name(lots, trades)
    t = F.struct(*trades.columns).alias("t")
    exact = keyed.join(trades.select(*KEY, t), KEY).select(keyed["*"], "t")
    return exact.unionByName(named.join(trades.select(*NAME, t), NAME).drop("name"))


def complex_totals(lots: DataFrame, trades: DataFrame) -> DataFrame:
    """lot, trades, amount: number and sum of the trades of a lot's complex, for lots that have any.

    Trades are added up by complex before lots meet them, so no pair of a lot and a
    trade is made.
    """
    keyed, named = by_key_or_name(lots, trades)
    sums = lambda by: trades.groupBy(*by).agg(F.count("*").alias("trades"), F.sum("amount").alias("amount"))
    both = [some.join(sums(by), by).select("lot", "trades", "amount") for some, by in ((keyed, KEY), (named, NAME))]
    return both[0].unionByName(both[1]).groupBy("lot").agg(F.sum("trades").alias("trades"), F.sum("amount").alias("amount"))


def similar_trades(lots: DataFrame, trades: DataFrame, share: float = 0.2) -> DataFrame:
    """Per lot: trades of its town within ``share`` of its area."""
    # trades are counted by area first, and meet lots by areas of one magnitude
    width = math.log((1 + share) / (1 - share))
    size = lambda c: F.floor(F.ln(c) / width)
    t = trades.where("area > 0").groupBy("sgg", "umd", F.col("area").alias("t_area")).agg(F.count("*").alias("n")).withColumn("size", size(F.col("t_area")))
    low, high = F.col("area") * (1 - share), F.col("area") * (1 + share)
    asked = lots.where("area > 0").select("lot", "sgg", "umd", low.alias("low"), high.alias("high")).withColumn("size", F.explode(F.sequence(size(F.col("low")), size(F.col("high")))))
    n = asked.join(t, ["sgg", "umd", "size"]).where("t_area between low and high").groupBy("lot").agg(F.sum("n").alias("similar"))
    return lots.select("lot").join(n, "lot", "left").select("lot", F.coalesce("similar", F.lit(0)).alias("similar"))


def trade_chips(lots: DataFrame, trades: DataFrame, save: Callable[[DataFrame], DataFrame], share: float = 0.05, newest: int = 100, days: int = 92) -> DataFrame:
    """Per lot: nb_count, the trades of its size in the last days among the newest hundred; recent price and day.

    Trades of a size are counted only if there are any; ties of a day go to the
    larger trade_id, then amount. The newest come first, so those of the last days
    among them are as many as there are, or all of the hundred. It takes the hundred
    latest days of each complex and size, worked out once for the lots that agree in
    both, and no pair of a lot and a trade. ``save`` writes and rereads what lots have
    by number, so that its shuffles can go before those by name begin.
    """
    near = F.col("t_area").between(F.col("area") * (1 - share), F.col("area") * (1 + share))
    latest = F.slice(F.sort_array(F.flatten(F.collect_list("days")), asc=False), 1, newest).alias("days")

    def of_complex(some: DataFrame, by: list[str]) -> DataFrame:
        # dealt by complex once, for what follows too
        t = trades.select(*by, F.col("area").alias("t_area"), F.struct("deal_date", "trade_id", "amount").alias("t")).where("t_area is not null").repartition(*by)
        order = W.partitionBy(*by, "t_area").orderBy(F.col("t").desc())
        top = t.withColumn("n", F.row_number().over(order)).where(F.col("n") <= newest)
        sizes = top.groupBy(*by, "t_area").agg(F.max("t").alias("last"), F.collect_list("t.deal_date").alias("days"))
        asked = some.select(*by, "area").distinct()
        per = asked.join(sizes, by).where(near).groupBy(*by, "area").agg(F.max("last").alias("last"), latest)
        late = F.size(F.filter("days", lambda d: d >= F.date_sub("as_of", days)))
        return some.select("lot", "as_of", *by, "area").join(per, [*by, "area"]).select("lot", late.alias("late"), "last")

    keyed, named = by_key_or_name(lots, trades)
    all_of = save(of_complex(keyed, KEY)).unionByName(of_complex(named, NAME))
    per = all_of.groupBy("lot").agg(F.least(F.sum("late"), F.lit(newest).cast("long")).alias("nb_count"), F.max("last").alias("last"))
    return lots.select("lot").join(per, "lot", "left").select("lot", F.coalesce("nb_count", F.lit(0)).alias("nb_count"), F.col("last.amount").alias("recent_price"), F.col("last.deal_date").alias("recent_date"))


def most_frequent(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """Most frequent value per key; of equals the one seen first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), "first")).alias(value), F.max("n").alias("n"))


def match_complexes(lots: DataFrame, complexes: DataFrame, accept: float = 0.6, stored: DataFrame | None = None) -> DataFrame:
    """lot, complex_no, score: the best complex that shares a district and a town with the lot's address.

    ``lots``: lot, address; ``complexes``: complex_no, name, address and maybe tag.
    Half a point for the region; half for a name within the other, 0.4 for the lot's
    name within the tag, a fifth for four equal first characters. ``stored`` has
    matches of an earlier run (lot, complex_no, region_ok), which win: a lot with a
    complex or with a known region isn't matched again, and has that complex, without
    a score, if the region was right.

    Only names and regions decide: lots that agree in both are matched once, with the
    smallest of the complexes that agree in both and in the tag. Pairs come from an
    equi-join on (district, town), not on the district alone, whose tokens are too
    common. Ties go to the smaller complex_no.
    """
    tokens = lambda c: (S.district_tokens(c).alias("districts"), S.town_tokens(c).alias("towns"))
    region = lambda df: df.withColumn("district", F.explode("districts")).withColumn("town", F.explode("towns")).drop("districts", "towns")
    settled = None
    if stored is not None:
        settled = stored.where("nullif(complex_no, '') is not null or region_ok is not null")
        lots = lots.join(settled.select("lot"), "lot", "left_anti")
    # the name's steps are the dear part: an address goes through them once, before anything filters or hashes the result
    read = saver(lots.sparkSession)(lots.select("lot", S.canonical_name(S.complex_name(F.col("address"))).alias("a"), *tokens(F.col("address"))))
    named = read.where("a <> ''").withColumn("alike", F.xxhash64("a", "districts", "towns"))
    a = region(named.select("a", "districts", "towns", "alike").distinct()).withColumnRenamed("alike", "lot")
    tag = S.canonical_name(F.col("tag")) if "tag" in complexes.columns else F.lit("")
    few = complexes.select("complex_no", S.canonical_name(F.col("name")).alias("b"), tag.alias("tag"), *tokens(F.col("address"))).groupBy("b", "tag", "districts", "towns").agg(F.min("complex_no").alias("complex_no"))
    pairs = a.join(region(few), ["district", "town"]).select("lot", "complex_no", "a", "b", "tag").distinct()
    within = (F.col("b") != "") & (F.expr("contains(a, b)") | F.expr("contains(b, a)"))
    score = F.when(within, 1.0).when(F.expr("contains(tag, a)"), 0.9).when((F.col("b") != "") & (F.substring("a", 1, 4) == F.substring("b", 1, 4)), 0.7).otherwise(0.5)
    scored = pairs.withColumn("score", score)
    top = scored.groupBy("lot").agg(F.max("score").alias("score"))
    best = scored.join(top.where(F.col("score") >= accept), ["lot", "score"]).groupBy(F.col("lot").alias("alike"), "score").agg(F.min("complex_no").alias("complex_no"))
    found = named.select("lot", "alike").join(best, "alike").select("lot", "complex_no", "score")
    if settled is None:
        return found
    known = settled.where("region_ok and nullif(complex_no, '') is not null").select("lot", F.col("complex_no").cast(complexes.schema["complex_no"].dataType).alias("complex_no"), F.lit(None).cast("double").alias("score"))
    return found.unionByName(known)


#: Letters that a common subsequence has to have, and the part of the name.
LEAST_COMMON, COMMON_PART = 4, 0.7


def letters(text: Column) -> Column:
    """The letters of a text, each with its number among the equal ones before it, so that none repeats."""
    own = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))
    return F.transform(own, lambda x, i: F.concat(x, F.size(F.filter(F.slice(own, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def coverable(names: DataFrame, register: DataFrame, by: str) -> DataFrame:
    """Distinct (by, a, b) that may have a common subsequence of 70 % of ``a`` and four letters; none that has is missing.

    Such a ``b`` lacks at most as many letters of ``a`` as may be left out. So of any
    one letter more than that it has at least one: those that the fewest spellings of
    the district's register hold are joined, then all letters are counted.
    """
    needed = F.greatest(F.lit(LEAST_COMMON), F.ceil(F.lit(COMMON_PART) * F.length("a") - F.lit(1e-9)).cast("int"))
    a = names.select(by, "a").distinct().where(F.length("a") >= LEAST_COMMON)
    b = register.select(by, "b").distinct().where(F.length("b") >= LEAST_COMMON)
    held = b.select(by, "b", F.explode(letters(F.col("b"))).alias("letter"))
    often = held.groupBy(by, "letter").agg(F.count("*").alias("n"))
    own = a.select(by, "a", F.explode(letters(F.col("a"))).alias("letter")).join(often, [by, "letter"], "left")
    rare = own.groupBy(by, "a").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "letter"))).alias("all"))
    prefix = rare.select(by, "a", F.explode(F.slice("all", F.lit(1), F.length("a") - needed + 1)).alias("x")).select(by, "a", F.col("x.letter").alias("letter"))
    met = prefix.join(held, [by, "letter"]).select(by, "a", "b").distinct()
    return met.where((F.length("b") >= needed) & (F.size(F.array_intersect(letters(F.col("a")), letters(F.col("b")))) >= needed))


def match_register(names: DataFrame, register: DataFrame) -> DataFrame:
    """id, code, score: the register's complex of a district that a name fits best.

    Equal names score 1000, one within the other 500 less the difference in length,
    else 300 and more if the common subsequence covers 70 % of the name and is four
    long. A name must cover 60 % of what it is matched with. Names are compared once
    per district and spelling, with the smallest code of each spelling in the
    register; ties go to the smaller code. Equal and contained names are found by
    pieces (``substrings``), the others by rare letters (``coverable``); the
    vectorised helper sees only pairs whose letters allow such a subsequence.
    """
    flat = lambda c: F.regexp_replace(c, r"\s+", "")
    named = names.select("id", "district", flat("name").alias("a")).where("a <> ''")
    b = register.select("code", "district", flat("name").alias("b")).where("b <> ''").groupBy("district", "b").agg(F.min("code").alias("code"))
    spelled = named.select("district", "a").distinct()
    apart = F.abs(F.length("a") - F.length("b"))
    inside = containing(spelled.withColumnRenamed("a", "text"), b.withColumnRenamed("b", "needle"), ("district",)).select("district", F.col("text").alias("a"), F.col("needle").alias("b"))
    around = containing(b.withColumnRenamed("b", "text"), spelled.withColumnRenamed("a", "needle"), ("district",)).select("district", F.col("needle").alias("a"), F.col("text").alias("b"))
    plain = F.when(F.col("a") == F.col("b"), 1000.0).otherwise(500.0 - apart)
    easy = inside.unionByName(around).distinct().join(b, ["district", "b"]).withColumn("score", plain).withColumn("l", F.least(F.length("a"), F.length("b")))
    able = coverable(spelled, b, "district").where("not contains(a, b) and not contains(b, a)").withColumn("l", lcs("a", "b"))
    hard = able.where(f"l >= {LEAST_COMMON} and l >= {COMMON_PART} * length(a)").join(b, ["district", "b"]).withColumn("score", 300 + F.col("l") / F.length("a") * 100 - apart * 0.5)
    cols = ["district", "a", "b", "code", "l", "score"]
    best = easy.select(cols).unionByName(hard.select(cols)).groupBy("district", "a").agg(F.max_by(F.struct("code", "b", "l", "score"), F.struct("score", -F.col("code"))).alias("m"))
    fits = best.select("district", "a", "m.*").where("a = b or l >= 0.6 * length(b)").select("district", "a", "code", F.round("score", 6).alias("score"))
    return named.join(fits, ["district", "a"]).select("id", "code", "score")


def asking_counts(lots: DataFrame, listings: DataFrame, band: float = 3.0) -> DataFrame:
    """lot, asking: listings of the lot's complex within the band of its area; all of them without an area."""
    # listings are counted by area first, and meet lots by stretches of area
    cell = lambda c: F.floor(c / (2 * band))
    l = listings.groupBy("complex_no", F.col("area").alias("l_area")).agg(F.count("*").alias("n"))
    low, high = F.bround(F.col("area") - band, 2), F.bround(F.col("area") + band, 2)
    asked = lots.where("area is not null").select("lot", "complex_no", low.alias("low"), high.alias("high")).withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    sized = asked.join(l.withColumn("cell", cell(F.col("l_area"))), ["complex_no", "cell"]).where("l_area between low and high").groupBy("lot").agg(F.sum("n").alias("asking"))
    whole = lots.where("area is null").select("lot", "complex_no").join(l.groupBy("complex_no").agg(F.sum("n").alias("asking")), "complex_no").select("lot", "asking")
    n = sized.unionByName(whole)
    return lots.select("lot").join(n, "lot", "left").select("lot", F.coalesce("asking", F.lit(0)).alias("asking"))


def posted_price(lots: DataFrame, units: DataFrame, tol: float = 0.7) -> DataFrame:
    """lot, year, price, n: median posted price of the latest year's units.

    Of the lot's area if there are such units, then of its floor if there are. All
    are narrowed with windows; the median is cut to whole won.
    ``units``: lot, year, area, floor, price; ``lots``: lot, area, floor.
    """
    lot = W.partitionBy("lot")
    u = units.join(lots.select("lot", F.col("area").alias("w_area"), F.col("floor").alias("w_floor")), "lot").withColumn("latest", F.max("year").over(lot)).where("year = latest")
    u = u.withColumn("fits", F.coalesce(F.abs(F.col("area") - F.col("w_area")) <= tol, F.lit(True))).withColumn("some", F.max(F.col("fits").cast("int")).over(lot)).where("fits or some = 0")
    u = u.withColumn("level", F.coalesce(F.col("floor") == F.col("w_floor"), F.lit(False))).withColumn("any", F.max(F.col("level").cast("int")).over(lot)).where("level or any = 0")
    return medians(u, ["lot", "year"], "price").select("lot", "year", F.floor("median").cast("long").alias("price"), "n")


def winning_rounds(lots: DataFrame, rounds: DataFrame, first: bool = False) -> DataFrame:
    """Lots with sale_price, bid_count and winner filled from their winning round.

    The round with the lot's own price, else the latest sale (the first one with
    ``first``). What the lot knows stays. ``rounds``: lot, id, result, sale_price,
    bid_count, winner_name.
    """
    sold = rounds.where(F.col("result").startswith("매각")).select("lot", F.struct("id", F.col("sale_price"), F.col("bid_count"), F.col("winner_name")).alias("r"))
    j = lots.join(sold, "lot", "left")
    rank = F.struct(F.lit(0), -F.col("r.id")) if first else F.struct(F.coalesce((F.col("r.sale_price") == F.col("sale_price")).cast("int"), F.lit(0)), F.col("r.id"))
    pick = j.groupBy("lot").agg(F.max_by("r", F.when(F.col("r").isNotNull(), rank)).alias("r"))
    return lots.join(pick, "lot").select("lot", F.coalesce("sale_price", "r.sale_price").alias("sale_price"), F.coalesce("bid_count", "r.bid_count").alias("bid_count"), F.col("r.winner_name").alias("winner_name"))


def resolve_district(lots: DataFrame, districts: DataFrame) -> DataFrame:
    """lot, code: the longest district key all of whose tokens occur in the address.

    The first token may stand in any of its province's spellings; ``인천 남구`` is
    read by its new name. ``districts``: key, code. A key meets the addresses that
    contain its rarest further token, by the token's letters; addresses are read once
    per spelling.
    """
    old = F.regexp_replace("address", r"(인천(?:광역시)?)\s+남구(?=\s|$)", "$1 미추홀구")
    spellings = F.create_map(*(x for k, vs in S.PROVINCES.items() for x in (F.lit(k), F.array(*(F.lit(v) for v in [k, *vs])))))
    toks = districts.select("key", "code", F.split("key", " ").alias("toks"))
    keys = toks.select("key", "code", F.length("key").alias("n"), F.slice("toks", 2, 9).alias("rest"), F.coalesce(spellings[F.col("toks")[0]], F.array(F.col("toks")[0])).alias("heads"))
    each = keys.select("key", F.explode("rest").alias("needle"))
    often = each.groupBy("needle").agg(F.count("*").alias("often"))
    anchor = each.join(often, "needle").groupBy("key").agg(F.min_by("needle", F.struct("often", -F.length("needle"), "needle")).alias("needle"))
    alone = keys.where("size(rest) = 0").select("key", F.explode("heads").alias("needle"))
    anchors = anchor.select("key", "needle").unionByName(alone)
    a = lots.select("lot", old.alias("text"))
    met = containing(a, anchors).join(anchors, "needle").join(keys, "key")
    hit = met.where("exists(heads, h -> contains(text, h)) and forall(rest, t -> contains(text, t))")
    found = hit.groupBy("text").agg(F.max_by("code", F.struct("n", "code")).alias("code"))
    return a.join(found, "text", "left").select("lot", "code")


def resolve_town(names: DataFrame, codes: DataFrame, renamed: DataFrame) -> DataFrame:
    """id, code, step: ten-digit code of a legal town name, by successive joins on what is still open.

    1 the name itself; 2 with the province's new name; 3 with 읍 and 면 exchanged;
    4 the only town of that last token in the province; 5 among several the one that
    shares most middle tokens, if it is the only such. ``names``: id, name;
    ``codes``: name, code; ``renamed``: old, new.
    """
    n = names.withColumn("toks", F.split("name", " ")).join(F.broadcast(renamed), F.col("toks")[0] == F.col("old"), "left")
    n = n.withColumn("new_name", F.when(F.col("new").isNotNull(), F.concat_ws(" ", F.col("new"), F.array_join(F.slice("toks", 2, 9), " "))).otherwise(F.col("name"))).drop("old", "new")
    c = codes.select(F.col("name").alias("c_name"), "code").withColumn("c_toks", F.split("c_name", " "))

    def step(open_: DataFrame, key: Column, no: int) -> DataFrame:
        return open_.withColumn("k", key).join(c, F.col("k") == F.col("c_name")).select("id", "code", F.lit(no).alias("step"))

    swapped = F.when(F.col("new_name").endswith("읍"), F.regexp_replace("new_name", "읍$", "면")).when(F.col("new_name").endswith("면"), F.regexp_replace("new_name", "면$", "읍"))
    done = step(n, F.col("name"), 1)
    for key, no in ((F.col("new_name"), 2), (swapped, 3)):
        done = done.unionByName(step(n.join(done.select("id"), "id", "left_anti"), key, no))
    open_ = n.join(done.select("id"), "id", "left_anti").withColumn("n_toks", F.split("new_name", " ")).select("id", F.col("n_toks")[0].alias("p"), F.element_at("n_toks", -1).alias("leaf"), F.expr("slice(n_toks, 2, greatest(size(n_toks) - 2, 0))").alias("mids"))
    cand = open_.join(c.select("code", "c_name", F.col("c_toks")[0].alias("p"), F.element_at("c_toks", -1).alias("leaf")), ["p", "leaf"])
    cand = cand.withColumn("shared", F.expr("size(filter(mids, m -> contains(c_name, m)))"))
    w = W.partitionBy("id")
    top = cand.withColumn("all", F.count("*").over(w)).withColumn("best", F.max("shared").over(w)).where("shared = best").withColumn("tops", F.count("*").over(w))
    last = top.where("tops = 1 and (all = 1 or size(mids) > 0)").select("id", "code", F.when(F.col("all") == 1, 4).otherwise(5).alias("step"))
    return names.select("id").join(done.unionByName(last), "id", "left")
