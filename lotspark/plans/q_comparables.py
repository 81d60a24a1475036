"""Comparable sales, expected bids and grades."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import comparables, grading, search, vehicles
from ..sources.driver_tables import oracle, table

c = F.col


def _line(spark, d):
    """Line items as sales of a building: the driver mapping of the survey."""
    li = table(spark, d, "lineitem")
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return li.select(
        key.alias("key"), c("l_partkey").alias("building"), c("l_quantity").alias("area"), c("l_extendedprice").alias("appraisal"), c("l_shipdate").cast("date").alias("day"),
        F.lit(0).alias("bracket"), (100 * (1 - 5 * c("l_discount"))).alias("rate"), F.floor("l_extendedprice").cast("long").alias("sale_price"), c("l_linestatus").alias("status"), "l_orderkey",
    )


def j4_same_building(spark, d):
    """Expected bid of live lots from sales of the same building; keys are hashed, so results go by order and price."""
    x = _line(spark, d)
    t, k = x.where("status = 'O'"), x.where("status = 'F'")
    pairs = comparables.same_building(t, k, price_tol=5000)
    out = comparables.expected_bid(t, pairs, c("rate") > 60)
    return out.join(t.select(c("key").alias("target"), "l_orderkey", "appraisal"), "target").select("l_orderkey", "appraisal", "available", "expected_bid", "cases", "excluded")


_X = """x as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity as area, l_extendedprice as appraisal, cast(l_shipdate as date) as day, 100 * (1 - 5 * l_discount) as rate, floor(l_extendedprice)::bigint as sale_price, l_linestatus as status,
  l_shipdate, l_extendedprice from lineitem),
t as (select row_number() over () as tid, * from x where status = 'O'),
k as (select distinct on (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) * from x where status = 'F'),
p as (select tid, t.l_orderkey, t.appraisal, k.rate, k.sale_price from t left join k on t.l_partkey = k.l_partkey and abs(t.area - k.area) <= 6 and abs(t.appraisal - k.appraisal) <= 5000 and k.day between (t.day - interval 36 month)::date and t.day),
e as (select l_orderkey, appraisal, count(*) filter (rate > 60) as cases, count(*) filter (rate <= 60) as excluded, round_even(avg(sale_price) filter (rate > 60), 0)::bigint as expected_bid from p group by tid, l_orderkey, appraisal)"""


def grade_comparables(spark, d):
    """Live lots that can be bought well below value, by sales of the same building: lots, normalised, joined, graded."""
    it = table(spark, d, "items")
    a = c("address")
    n = it.select(c("item_key").alias("key"), S.building_prefix(a).alias("building"), S.exclusive_area(c("area_text"), c("building_area")).alias("area"), c("appraisal_price").alias("appraisal"), S.floor_bracket(S.floor_no(a)).alias("bracket"), S.sale_date(c("sell_date")).alias("day"), S.sale_rate(c("sale_rate")).alias("rate"), "sale_price", "est_price", "min_price", "status")
    t, k = n.where("status <> 'F'"), n.where("status = 'F'")
    bids = comparables.expected_bid(t, comparables.same_building(t, k), c("rate") > 60)
    j = bids.join(t.select(c("key").alias("target"), c("est_price").alias("price"), c("min_price").alias("minimum")), "target").withColumnRenamed("expected_bid", "expected")
    return grading.buy_grade(j).select(c("target").alias("item_key"), "expected", "cases", "excluded", "base", "profit", "grade")


_N = r"""n as (select item_key, trim(regexp_replace(regexp_replace(address, '\s+(제?\d+동|지하\s*\d*층|제?\d+층|[Bb]\d+|\d+호)[\s\S]*$', ''), '\s+', ' ', 'g')) as building,
  coalesce(nullif(regexp_extract(area_text, '전용\s*([0-9.]+)', 1), ''), nullif(regexp_extract(building_area, '([0-9.]+)\s*(?:㎡|m²|m2)', 1), ''))::double as area, appraisal_price as appraisal,
  nullif(regexp_extract(address, '(\d+)\s*층', 1), '')::int as floor, sell_day as day, nullif(regexp_extract(sale_rate, '([0-9.]+)', 1), '')::double as rate, sale_price, est_price, min_price, status, lat, lng from items),
m as (select *, case when floor <= 6 then 0 when floor >= 7 then 1 end as bracket from n)"""


def j5_radius(spark, d):
    """Expected bid of live lots from sales within a kilometre."""
    it = table(spark, d, "items")
    n = it.select(c("item_key").alias("key"), "lat", "lng", S.exclusive_area(c("area_text"), c("building_area")).alias("area"), c("appraisal_price").alias("appraisal"), S.floor_no(c("address")).alias("floor"), c("sell_day").alias("day"), S.sale_rate(c("sale_rate")).alias("rate"), "sale_price", "status")
    t, k = n.where("status <> 'F'"), n.where("status = 'F'")
    return comparables.expected_bid(t, comparables.within_radius(t, k), c("rate") < 100, hashed=True)


def j6_vehicles(spark, d):
    v = table(spark, d, "vehicles").withColumn("model", S.plain_model(c("model"), c("maker")))
    return comparables.vehicle_median(v.where("live"), v.where("not live"), F.lit(dt.date(2000, 6, 1)))


_AS_OF = "date '2000-06-01'"


def r5_vehicle_grade(spark, d):
    v = table(spark, d, "vehicles").withColumn("model_year", F.when(c("id") % 9 != 0, c("model_year")))
    return vehicles.purchase_grade(v, F.lit(2024))


def j11_ads(spark, d):
    v = table(spark, d, "vehicles")
    t = v.where("live").select("id", F.array(F.replace("maker", F.lit("#"), F.lit(""))).alias("terms"), c("model_year").alias("year"), vehicles.fuel_group(c("fuel")).alias("fuel"), "mileage", F.when(c("id") % 2 == 0, 2.2).alias("litre"))
    a = v.where("not live").select(c("id").alias("ad"), F.concat(F.lit("new "), F.replace("maker", F.lit("#"), F.lit("")), F.when(c("id") % 3 == 0, " 2.2 4wd").when(c("id") % 3 == 1, " 3.0").otherwise("")).alias("text"), c("model_year").alias("year"), vehicles.fuel_group(c("fuel")).alias("fuel"), "mileage", "price")
    return vehicles.match_ads(t, a, km=2000)


J11 = oracle("""with f as (select *, case when contains(fuel, '하이브리드') then 'hybrid' when fuel = '경유' then 'diesel' else 'petrol' end as g, split_part(maker, '#', 2) as no from vehicles),
t as (select id, no, model_year as year, g, mileage, case when id % 2 = 0 then 2.2 end as litre from f where live),
a as (select id as ad, no, model_year as year, g, mileage, price, case when id % 3 = 0 then 2.2 when id % 3 = 1 then 3.0 end as size from f where not live),
p0 as (select distinct t.id, t.g, litre, a.ad, size, a.g as ag, price from t join a on t.no = a.no and a.year between t.year - 1 and t.year + 1 and a.mileage between greatest(0, t.mileage - 2000) and t.mileage + 2000),
p1 as (select *, max(case when g = ag then 1 else 0 end) over (partition by id) as strict from p0),
p2 as (select *, row_number() over (partition by id order by price, ad) as n from p1 where g = ag or strict = 0),
p3 as (select *, row_number() over (partition by id order by price, ad) as k from p2 where n <= 300 and (litre is null or size is null or abs(size - litre) <= 0.1))
select id, count(*) as ads, round_even(avg(nullif(price, 0)), 0)::bigint as mean_price, max(strict) = 0 as relaxed from p3 where k <= 60 group by id""")


CLASS_NAMES = ["SUV", "승용자동차", "해치백", "지게차", "중형", "Sorento"]


def f7_generic(spark, d):
    """Vehicles of which only a class word is known match no ad, though ads name it."""
    v = table(spark, d, "vehicles")
    name = F.array(*map(F.lit, CLASS_NAMES))[(c("id") % len(CLASS_NAMES)).cast("int")]
    t = v.where("live").select("id", F.array(name).alias("terms"), c("model_year").alias("year"), vehicles.fuel_group(c("fuel")).alias("fuel"), "mileage", F.lit(None).cast("double").alias("litre"))
    return vehicles.match_ads(t, v.where("not live").select(c("id").alias("ad"), name.alias("text"), c("model_year").alias("year"), vehicles.fuel_group(c("fuel")).alias("fuel"), "mileage", "price"), km=200).select("id", "ads")


F7 = oracle("""with f as (select id, live, model_year as year, mileage, case when contains(fuel, '하이브리드') then 'hybrid' when fuel = '경유' then 'diesel' else 'petrol' end as g from vehicles where id % 6 = 5),
p as (select a.id, b.id as ad, (a.g = b.g)::int as same from f a join f b on a.live and not b.live and b.year between a.year - 1 and a.year + 1 and b.mileage between a.mileage - 200 and a.mileage + 200),
q as (select *, max(same) over (partition by id) as strict from p)
select id, least(count(distinct ad), 60)::bigint as ads from q where same = 1 or strict = 0 group by id""")


def p20_body(spark, d):
    """Body types of model names by the whole list."""
    names = ["싼타페 TM", "Santa Fe", "쏘나타", "Arteon X1", "Q50 Q5", "아테온", "suv", "Model Y", "320d", "Range Rover Evoque", "K5", "모델 X", "그랜드 체로키", ""]
    v = table(spark, d, "vehicles")
    return v.select("id", S.body_type(F.array(*map(F.lit, names))[(c("id") % len(names)).cast("int")]).alias("body"))


P20 = oracle("select id, case when id % 14 in (0, 1, 6, 7, 9, 11, 12) then 'SUV' else '승용자동차' end as body from vehicles")


def j12_reviews(spark, d):
    v = table(spark, d, "vehicles")
    t = v.where("live").select("id", c("maker").alias("word"), c("model_year").alias("year"), c("fuel"))
    r = table(spark, d, "part").select(c("p_partkey").alias("review"), c("p_brand").alias("word"), F.when(c("p_partkey") % 7 != 0, 2000 + c("p_size") % 22).alias("year"), F.when(c("p_partkey") % 3 == 0, "가솔린").otherwise("경유").alias("fuel"), c("p_name").alias("model"))
    return vehicles.best_reviews(t, r)


J12 = oracle("""with t as (select row_number() over () as n_t, id, maker, model_year as year, fuel from vehicles where live),
r as (select p_partkey as review, p_brand as maker, case when p_partkey % 7 <> 0 then 2000 + p_size % 22 end as year, case when p_partkey % 3 = 0 then '가솔린' else '경유' end as fuel, length(p_name) as n from part),
k as (select n_t, id, review, row_number() over (partition by n_t order by coalesce(abs(t.year - r.year), 99), case when t.fuel = r.fuel then 0 else 1 end, n desc, review) as place from t join r using (maker))
select id, max(review) filter (place = 1) as review, coalesce(string_agg(review::varchar, ',' order by place) filter (place > 1), '') as others from k where place <= 6 group by n_t, id""")


def r4_fallback(spark, d):
    it = table(spark, d, "items").select("item_key", c("est_price").alias("price"), F.lit(None).cast("long").alias("expected"), c("min_price").alias("minimum"), F.when(c("seq") % 5 != 0, c("appraisal_price")).alias("recent"))
    return grading.fallback_grade(it).select("item_key", "profit", "grade")


def r6_short_sale(spark, d):
    it = table(spark, d, "items").where("est_price is not null")
    s = it.select("item_key", c("min_price").alias("bid"), c("est_price").alias("sell"), c("appraisal_price").alias("appraisal"), F.floor(c("min_price") / 10).cast("long").alias("deposit"), S.exclusive_area(c("area_text"), c("building_area")).__add__(30).alias("area"))
    return grading.short_sale(s).select("item_key", "diff", "loan", "acq", "tax", "net", "total", "yield")


def _bands(i: int, top: float) -> str:
    return "case " + " ".join(f"when inc <= {t[0]} then {float(t[i])!r}::double" for t in grading.INCOME_TAX) + f" else {float(top)!r}::double end"


R6 = oracle(rf"""with s0 as (select item_key, min_price as bid, est_price as sell, appraisal_price as appraisal, floor(min_price / 10)::bigint as deposit,
  coalesce(nullif(regexp_extract(area_text, '전용\s*([0-9.]+)', 1), ''), nullif(regexp_extract(building_area, '([0-9.]+)\s*(?:㎡|m²|m2)', 1), ''))::double + 30 as area from items where est_price is not null),
s1 as (select *, bid::double / 1e8::double as eok, sell::double - bid as diff, appraisal * 60::double / 100 as la, bid * 80::double / 100 as lb from s0),
s2 as (select *, round_even(case when eok <= 6 then 1.0::double when eok <= 9 then eok * 2 / 3 - 3 else 3.0::double end * 100, 0) / 100 as base, case when appraisal > 0 and la < lb then la else lb end as loan, greatest(0.0::double, diff) as inc from s1),
s3 as (select *, round_even(bid::double * base / 100, 0) as acq0, {_bands(1, grading.TOP_TAX[0])} as pct, {_bands(2, grading.TOP_TAX[1])} as ded from s2),
s4 as (select *, acq0 + case when coalesce(area > 85, false) then round_even(bid * 0.2::double / 100, 0) else 0 end + round_even(acq0 * 0.1::double, 0) + case when bid <= 100000000 then 0 when bid <= 1000000000 then 150000 else 350000 end as acq, inc * pct / 100 as gross from s3),
s5 as (select *, greatest(0.0::double, gross - ded) as tax, loan * 0.5::double / 100 + 3 * (loan * 5.0::double / 100 / 12) + acq + 200000 as costs, bid - loan as capital from s4)
select item_key, diff::bigint as diff, round_even(loan, 0)::bigint as loan, acq::bigint as acq, round_even(tax, 0)::bigint as tax, round_even(diff - costs - tax, 0)::bigint as net,
  round_even(deposit + (capital - deposit) + costs + gross, 0)::bigint as total, case when capital > 0 then round_even((diff - costs - tax) / capital * 100, 1) end as yield from s5""")


def t2_top_profit(spark, d):
    """Two best lots per kind of home by net profit, of those above the floor."""
    it = table(spark, d, "items").where("est_price is not null").withColumn("kind", S.home_kind(c("usage_name"))).where("kind is not null")
    s = it.select("item_key", "kind", c("min_price").alias("bid"), c("est_price").alias("sell"), c("appraisal_price").alias("appraisal"), F.lit(0).cast("long").alias("deposit"), F.lit(None).cast("double").alias("area"))
    net = grading.short_sale(s).where(c("net") >= grading.GOOD)
    return search.top_by(net, "kind", "net", 2, "item_key").select("kind", "place", "item_key", "net")


T2 = oracle(rf"""with s0 as (select item_key, min_price as bid, est_price as sell, appraisal_price as appraisal, replace(usage_name, ' ', '') as u from items where est_price is not null),
s1 as (select *, case when contains(u, '도시형') then '도시형생활주택' when contains(u, '상가주택') then '상가주택' when contains(u, '다가구') then '다가구주택' when contains(u, '다세대') or contains(u, '연립') then '빌라' when contains(u, '아파트') then '아파트' end as kind,
  bid::double / 1e8::double as eok, sell::double - bid as diff, appraisal * 60::double / 100 as la, bid * 80::double / 100 as lb from s0),
s2 as (select *, round_even(case when eok <= 6 then 1.0::double when eok <= 9 then eok * 2 / 3 - 3 else 3.0::double end * 100, 0) / 100 as base, case when appraisal > 0 and la < lb then la else lb end as loan, greatest(0.0::double, diff) as inc from s1),
s3 as (select *, round_even(bid::double * base / 100, 0) as acq0, {_bands(1, grading.TOP_TAX[0])} as pct, {_bands(2, grading.TOP_TAX[1])} as ded from s2),
s4 as (select *, acq0 + round_even(acq0 * 0.1::double, 0) + case when bid <= 100000000 then 0 when bid <= 1000000000 then 150000 else 350000 end as acq, inc * pct / 100 as gross from s3),
s5 as (select kind, item_key, round_even(diff - (loan * 0.5::double / 100 + 3 * (loan * 5.0::double / 100 / 12) + acq + 200000) - greatest(0.0::double, gross - ded), 0)::bigint as net from s4 where kind is not null),
s6 as (select *, row_number() over (partition by kind order by net desc, item_key) as place from s5 where net >= 30000000)
select kind, place, item_key, net from s6 where place <= 2""")

QUERIES = {f.__name__: f for f in (f7_generic, p20_body, j4_same_building, grade_comparables, j5_radius, j6_vehicles, r5_vehicle_grade, j11_ads, j12_reviews, r4_fallback, r6_short_sale, t2_top_profit)}
ORACLES = {
    "f7_generic": F7, "p20_body": P20,
    "j4_same_building": f"with {_X} select l_orderkey, appraisal, coalesce(cases > 0, false) as available, expected_bid, coalesce(cases, 0) as cases, coalesce(excluded, 0) as excluded from e",
    "grade_comparables": oracle(f"""with {_N},
      p as (select t.item_key, k.rate, k.sale_price from m t join m k on t.building = k.building and t.bracket = k.bracket and abs(t.area - k.area) <= 6 and abs(t.appraisal - k.appraisal) <= 25000000 and k.day between (t.day - interval 36 month)::date and t.day
        where t.status <> 'F' and k.status = 'F' and k.sale_price > 0 and k.rate is not null),
      e as (select item_key, count(*) filter (rate > 60) as cases, count(*) filter (rate <= 60) as excluded, round_even(avg(sale_price) filter (rate > 60), 0)::bigint as expected from p group by 1),
      g as (select m.item_key, expected, coalesce(cases, 0) as cases, coalesce(excluded, 0) as excluded, greatest(nullif(expected, 0), nullif(min_price, 0)) as base, nullif(est_price, 0) as price from m left join e using (item_key) where status <> 'F')
      select item_key, expected, cases, excluded, base, price - base as profit, case when price is null or base > price then 'ban' when price - base >= 30000000 then 'good' else 'review' end as grade from g where price is null or base is not null"""),
    "j5_radius": oracle(f"""with {_N},
      p as (select t.item_key, k.rate, k.sale_price from m t join m k on abs(t.area - k.area) <= 6 and abs(t.appraisal - k.appraisal) <= 15000000 and abs(t.floor - k.floor) <= 1 and k.day between (t.day - interval 36 month)::date and t.day
        and 2 * 6371000.0 * asin(least(1.0, sqrt(sin(radians(k.lat - t.lat) / 2) ** 2 + cos(radians(t.lat)) * cos(radians(k.lat)) * sin(radians(k.lng - t.lng) / 2) ** 2))) <= 1000 where t.status <> 'F' and k.status = 'F' and k.sale_price > 0 and k.rate is not null),
      e as (select item_key, count(*) filter (rate < 100) as cases, count(*) filter (rate >= 100) as excluded, round_even(avg(sale_price) filter (rate < 100), 0)::bigint as expected_bid from p group by 1)
      select m.item_key as target, coalesce(cases > 0, false) as available, expected_bid, coalesce(cases, 0) as cases, coalesce(excluded, 0) as excluded from m left join e using (item_key) where status <> 'F'"""),
    "j6_vehicles": oracle(f"""with v as (select *, case when ends_with(model, maker) then trim(left(model, length(model) - length(maker))) else model end as m from vehicles),
      p as (select t.id as target, k.price from v t join v k on t.maker = k.maker and t.m = k.m and abs(t.model_year - k.model_year) <= 1 and k.mileage between t.mileage * (1 - 0.2::double) and t.mileage * (1 + 0.2::double) and k.sell_day >= {_AS_OF} - 1095 where t.live and not k.live and k.price > 0 and t.id <> k.id)
      select target, count(*) as cases, floor(quantile_cont(price, 0.5))::bigint as expected_bid from p group by 1 having count(*) >= 2"""),
    "r5_vehicle_grade": oracle(r"""with v as (select *, case when id % 9 <> 0 then model_year end as y from vehicles),
      w as (select id, case when y is not null then greatest(0, 2024 - y) * case when greatest(0, 2024 - y) <= 5 then 14000 else 13000 end + 9999 end as allowed, mileage, contains(note, '파손') as broken, accidents_self + accidents_other as n, damage, y from v),
      x as (select *, concat_ws(',', case when broken then 'damage' end, case when mileage > allowed then 'mileage' end, case when y is not null and n > 5 then 'accidents' end, case when y is not null and damage >= 6000000 then 'repair' end) as reasons from w)
      select id, allowed::bigint as allowed, case when y is not null or broken then reasons = '' end as ok, reasons from x"""),
    "j11_ads": J11, "j12_reviews": J12, "r6_short_sale": R6, "t2_top_profit": T2,
    "r4_fallback": oracle("select item_key, case when seq % 5 <> 0 then nullif(appraisal_price, 0) end - nullif(min_price, 0) as profit, case when case when seq % 5 <> 0 then nullif(appraisal_price, 0) end - nullif(min_price, 0) >= 30000000 then 'review' else 'ban' end as grade from items where est_price is null"),
}
