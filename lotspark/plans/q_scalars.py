"""Queries of the scalar functions (projections), each over every row of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.helpers import nfkc
from ..sources.driver_tables import COMPLEX, oracle, table

c = F.col


def _chain(text: str, rules: list[tuple[str, list[str]]], op: str = "contains") -> str:
    tests = lambda ws: " or ".join(f"contains({text}, '{w}')" if op == "contains" else f"regexp_matches({text}, '{w}')" for w in ws)
    return "case " + " ".join(f"when {tests(ws)} then '{k}'" for k, ws in rules) + " end"


def p_kinds(spark, d):
    """P1, P17, P18, P22, F1's kind of home."""
    it = table(spark, d, "items")
    return it.select(
        "seq", S.home_kind(c("usage_name")).alias("home"), S.map_group(F.lit("auction"), c("usage_name")).alias("map_auction"),
        S.map_group(F.lit("sale"), c("usage_name")).alias("map_sale"), S.regulation(c("address")).alias("reg"), S.lodging_kind(c("usage_name"), c("result")).alias("lodging"),
    )


def _map_sql(vehicle: bool) -> str:
    drop = f"regexp_matches(u, '{S.MAP_EXCLUDED}')" + (f" or regexp_matches(u, '{S.VEHICLE}')" if vehicle else "")
    return f"case when u = '' or {drop} then null else {_chain('u', [(k, [p]) for k, p in S.MAP_GROUPS], 're')} end"


P_KINDS = oracle(f"""
with u as (select seq, address, trim(usage_name) as u, replace(usage_name, ' ', '') as t, usage_name || ' ' || result as j from items)
select seq, {_chain('t', S.HOME_KINDS)} as home, {_map_sql(True)} as map_auction, {_map_sql(False)} as map_sale,
  case when address = '' then null when {' or '.join(f"contains(address, '{w}')" for w in S.REGULATED)} then 'regulated' when contains(address, '경기') or contains(address, '인천') then 'metro' else 'none' end as reg,
  {_chain('j', [(k, [p]) for k, p in S.LODGING], 're')} as lodging from u""")


def p_rights_text(spark, d):
    """Kinds, dates and amounts out of register texts."""
    r = table(spark, d, "rights")
    day = c("reg_date").cast("string")
    y, m, n = (F.substring(day, a, b) for a, b in ((1, 4), (6, 2), (9, 2)))
    text = F.when(c("seq") % 4 == 0, F.concat(y, F.lit("년 "), m.cast("int").cast("string"), F.lit("월 "), n, F.lit("일 제123호"))).when(c("seq") % 4 == 1, F.concat_ws(".", y, m, n)).when(c("seq") % 4 == 2, F.concat(F.lit("접수 "), y, m, n)).otherwise(F.concat(y, F.lit("-13-"), n))
    money = F.when(c("seq") % 3 == 0, F.concat(F.lit("금"), F.format_number("amount", 0), F.lit("원"))).when(c("seq") % 3 == 1, F.concat((c("amount") % 97).cast("string"), F.lit("억"), (c("amount") % 9973).cast("string"), F.lit("만원"))).otherwise(F.concat(text, F.lit(" 제11111호")))
    t = r.withColumn("text", text).withColumn("money", money)
    return t.select("lot", "seq", S.right_kind(c("purpose")).alias("kind"), S.date_kr(c("text")).alias("day"), S.amount_kr(c("money")).alias("amount"), S.won_text(c("amount")).alias("won"))


P_RIGHTS_TEXT = oracle(f"""
with t as (select *, cast(reg_date as string) as day, replace(purpose, ' ', '') as p from rights)
select lot, seq, {_chain('p', S.RIGHT_KINDS)} as kind, case when seq % 4 = 3 then null else reg_date end as day,
  case when seq % 3 = 0 then amount when seq % 3 = 1 then case when (amount % 97) * 100000000 + (amount % 9973) * 10000 = 0 then 0 else (amount % 97) * 100000000 + (amount % 9973) * 10000 end else 0 end::bigint as amount,
  case when amount >= 100000000 and amount % 100000000 >= 10000 then (amount // 100000000)::varchar || '억 ' || format('{{:,}}', amount % 100000000 // 10000) || '만원'
    when amount >= 100000000 then (amount // 100000000)::varchar || '억원' when amount >= 10000 then format('{{:,}}', amount // 10000) || '만원' else format('{{:,}}', amount) || '원' end as won from t""")


def p_areas(spark, d):
    """P5, P6, P7, P8, P16, P32."""
    it = table(spark, d, "items")
    a, floor = c("address"), S.floor_or_unit(c("address"))
    return it.select(
        "seq", S.exclusive_area(c("area_text"), c("building_area")).alias("area"), S.first_area(c("area_text"), c("building_area")).alias("area_first"), S.floor_no(a).alias("floor"),
        S.floor_signed(a).alias("floor_signed"), floor.alias("floor_unit"), S.floor_bracket(S.floor_no(a)).alias("bracket"), S.pyeong(c("building_area")).alias("pyeong"),
        S.bid_ratio(c("min_price"), c("appraisal_price")).alias("ratio"), F.coalesce(S.home_kind(c("usage_name")) == "빌라", F.lit(False)).__and__(F.coalesce(floor >= 4, F.lit(False))).alias("lift_caution"),
    )


P_AREAS = oracle(r"""
with t as (select *, nullif(regexp_extract(address, '(\d+)\s*층', 1), '')::int as f, nullif(regexp_extract(address, '(\d{3,4})호', 1), '')::int as unit from items),
u as (select *, coalesce(f, unit // 100) as fu from t)
select seq, coalesce(nullif(regexp_extract(area_text, '전용\s*([0-9.]+)', 1), ''), nullif(regexp_extract(building_area, '([0-9.]+)\s*(?:㎡|m²|m2)', 1), ''))::double as area,
  coalesce(nullif(regexp_extract(area_text, '전용\s*(\d+(?:\.\d+)?)', 1), ''), nullif(regexp_extract(area_text, '(\d+(?:\.\d+)?)', 1), ''), nullif(regexp_extract(building_area, '(\d+(?:\.\d+)?)', 1), ''))::double as area_first,
  f as floor, coalesce(-coalesce(nullif(regexp_extract(address, '지하\s*(\d+)\s*층', 1), ''), nullif(regexp_extract(address, '[Bb](\d+)', 1), ''))::int, f) as floor_signed,
  fu as floor_unit, case when f <= 6 then 0 when f >= 7 then 1 end as bracket, nullif(regexp_extract(building_area, '([\d.]+)\s*평', 1), '')::double as pyeong,
  round_even(min_price * 100.0 / nullif(appraisal_price, 0), 0)::bigint as ratio, coalesce((contains(usage_name, '다세대') or contains(usage_name, '연립')) and fu >= 4, false) as lift_caution from u""")


def p_addresses(spark, d):
    """P9, P10, P11, P28, P29."""
    it = table(spark, d, "items")
    a = c("address")
    parts = it.withColumn("p", S.address_parts(a))
    return parts.select(
        "seq", S.building_prefix(a).alias("prefix"), S.dong_lot(a).alias("dong_lot"), S.geo_address(a).alias("geo"), F.array_join(S.geo_variants(a), "; ").alias("variants"),
        c("p.province").alias("province"), c("p.district").alias("district"), c("p.town").alias("town"), S.complex_name(a).alias("complex"),
        F.array_join(S.district_tokens(a), ",").alias("districts"), F.array_join(S.town_tokens(a), ",").alias("towns"),
    )


_ALIASES = " ".join(f"when t[1] in ({', '.join(repr(v) for v in [k, *vs])}) then '{k}'" for k, vs in S.PROVINCES.items())
_CITIES = " ".join(f"when t[1] = '{k}' then '{v}'" for k, v in S.CITY_PROVINCE.items())
P_ADDRESSES = oracle(rf"""
with a as (select seq, address, {COMPLEX} as complex, regexp_split_to_array(trim(address), '\s+') as t, trim(regexp_replace(regexp_replace(address, '\s+(제?\d+동|지하\s*\d*층|제?\d+층|[Bb]\d+|\d+호)[\s\S]*$', ''), '\s+', ' ', 'g')) as prefix from items),
b as (select *, nullif(trim(regexp_extract(address, '^(.*?[가-힣]+(?:동|읍|면|리|가)\s+(?:산\s*)?\d+(?:-\d+)?)', 1)), '') as geo, trim(regexp_replace(address, '\([^)]*\)', '', 'g')) as bare,
  case {_CITIES} end as city, list_filter(list_transform(string_split(regexp_extract(address, '\(([^)]*)\)', 1), ','), lambda x: trim(x)), lambda x: not regexp_matches(x, '(로|길)$') and regexp_matches(x, '(동|읍|면|리|가)$')) as br from a),
e as (select *, case when city is not null then t[2] else t[3] end as spot from b)
select seq, prefix, case when regexp_matches(prefix, '([가-힣]+(?:동|리|가))\s+(\d+(?:-\d+)?)') then regexp_extract(prefix, '([가-힣]+(?:동|리|가))\s+(\d+(?:-\d+)?)', 1) || ' ' || regexp_extract(prefix, '([가-힣]+(?:동|리|가))\s+(\d+(?:-\d+)?)', 2) end as dong_lot,
  geo, array_to_string(list_filter([geo, case when prefix is distinct from geo then prefix end, case when bare is distinct from geo and bare is distinct from prefix then bare end], lambda x: x is not null and x <> ''), '; ') as variants,
  coalesce(city, case {_ALIASES} end, t[1]) as province, case when city is not null then t[1] else t[2] end as district,
  case when not regexp_matches(spot, '(로|길)$') and regexp_matches(spot, '(동|읍|면|리|가)$') then spot else coalesce(br[1], '') end as town,
  complex,
  array_to_string(list_distinct_in_order(list_filter(regexp_extract_all(address, '([가-힣]+(?:시|군|구))', 1), lambda x: length(x) >= 2)), ',') as districts,
  array_to_string(list_distinct_in_order(list_filter(regexp_extract_all(address, '([가-힣]+(?:읍|면|동|리|가))', 1), lambda x: length(x) >= 2)), ',') as towns from e""")
for _l in ("list_distinct_in_order(",):  # DuckDB's list_distinct has no order of its own
    while _l in P_ADDRESSES:
        at = P_ADDRESSES.index(_l)
        depth, end = 1, at + len(_l)
        while depth:
            depth += {"(": 1, ")": -1}.get(P_ADDRESSES[end], 0)
            end += 1
        inner = P_ADDRESSES[at + len(_l) : end - 1]
        P_ADDRESSES = P_ADDRESSES[:at] + f"list_filter({inner}, lambda x, i: list_position({inner}, x) = i)" + P_ADDRESSES[end:]


def p_cases(spark, d):
    """P12, P13, P14, P15, P35 and the cleaned sale date and rate."""
    it = table(spark, d, "items")
    return it.select(
        "seq", S.case_label(c("title"), c("case_no")).alias("label"), S.case_query(F.coalesce("title", "case_no")).alias("query"), S.court_name(F.lit("부산지법"), F.when(c("seq") % 2 == 0, "서부지원").otherwise("본원")).alias("court"),
        S.masked_name(S.winner(c("sell_date"))).alias("winner"), S.bidders(c("sell_date")).alias("bidders"), S.reconciled_result(c("result"), c("data_class"), c("status_reason")).alias("result"),
        S.sale_date(c("sell_date")).alias("day"), S.sale_rate(c("sale_rate")).alias("rate"),
    )


P_CASES = oracle(rf"""
with t as (select *, nullif(trim(regexp_extract(sell_date, '^\s*\d{{4}}-\d{{2}}-\d{{2}}\s+\d+\s*명\s+(.+)$', 1)), '') as w, coalesce(title, case_no) as q from items)
select seq, case when regexp_matches(coalesce(title, ''), '(\d{{4}})\s*타경\s*(\d+)') then regexp_extract(title, '(\d{{4}})\s*타경\s*(\d+)', 1) || '타경' || regexp_extract(title, '(\d{{4}})\s*타경\s*(\d+)', 2)
    else regexp_extract(case_no, '^(\d{{4}})-(\d+)', 1) || '타경' || regexp_extract(case_no, '^(\d{{4}})-(\d+)', 2) end as label,
  case when regexp_matches(q, '^\s*(\d{{4}})\s*(?:타경|-)\s*(\d+)\s*$') then regexp_extract(q, '^\s*(\d{{4}})\s*(?:타경|-)\s*(\d+)\s*$', 1) || '-' || regexp_extract(q, '^\s*(\d{{4}})\s*(?:타경|-)\s*(\d+)\s*$', 2) else regexp_replace(q, '[^0-9]', '', 'g') end as query,
  case when seq % 2 = 0 then '부산서부지원' else '부산지방법원' end as court,
  case when w is null then '' when regexp_matches(w, '{S.AGENCIES}') then w when length(w) = 1 then '○' when length(w) = 2 then substr(w, 1, 1) || '○' else substr(w, 1, 1) || repeat('○', length(w) - 2) || right(w, 1) end as winner,
  nullif(regexp_extract(sell_date, '^\s*\d{{4}}-\d{{2}}-\d{{2}}\s+(\d+)\s*명\s+.+$', 1), '')::int as bidders,
  case when regexp_matches(result, '^(신건|유찰)') and data_class = '백데이터' and regexp_matches(status_reason, '^(매각|잔금납부|배당|재매각)') then '매각' else result end as result,
  sell_day as day, nullif(regexp_extract(sale_rate, '([0-9.]+)', 1), '')::double as rate from t""")


def p_vehicles(spark, d):
    """P20, P21, P36 and the fuel group."""
    v = table(spark, d, "vehicles")
    badge = F.concat(F.lit("2.2 4WD "), (c("mileage") / 10000).cast("decimal(6,1)").cast("string"))
    return v.select("id", S.plain_model(c("model"), c("maker")).alias("model"), S.body_type(F.concat("model", F.lit(" x5")), ["x5", "ECONOMY"], ["standard"]).alias("body"), F.array_join(F.transform(S.litres(badge), lambda x: x.cast("string")), ",").alias("litres"))


P_VEHICLES = oracle(r"""
with t as (select *, (mileage / 10000)::decimal(6,1) as l, lower(replace(model, ' ', '') || 'x5') as m from vehicles)
select id, case when ends_with(model, maker) then trim(left(model, length(model) - length(maker))) else model end as model,
  case when contains(m, 'standard') then '승용자동차' else 'SUV' end as body, case when l between 0.6 and 8.0 then '2.2,' || l::varchar else '2.2' end as litres from t""")


def p_web(spark, d):
    """Titles, hosts and texts of pages."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    stamp = F.when(c("page_id") % 2 == 0, F.concat(F.lit("2024-03-0"), (c("page_id") % 9 + 1).cast("string"), F.lit("T20:30:00Z"))).otherwise("2024-03-05")
    t = p.withColumn("at", S.kst(stamp))
    return t.select("page_id", S.page_title(c("html")).alias("title"), S.site_name(c("url")).alias("site"), F.length(S.stripped_tags(c("html"))).alias("chars"), F.md5(S.stripped_tags(c("html"))).alias("text"), c("at.ts").alias("ts"), c("at.has_time").alias("has_time"))


P_WEB = r"""
with t as (select page_id, url, html, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as x from pages)
select page_id, coalesce(nullif(regexp_extract(html, '<meta[^>]+property="og:title"[^>]+content="([^"]*)"', 1, 'i'), ''), trim(nullif(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), ''))) as title,
  regexp_replace(lower(nullif(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1), '')), '^(www\.|m\.)', '') as site, length(x)::int as chars, md5(x) as text,
  case when page_id % 2 = 0 then timestamp '2024-03-02 05:30:00' + to_days((page_id % 9)::int) else timestamp '2024-03-05' end as ts, page_id % 2 = 0 as has_time from t"""


def p_geo(spark, d):
    """Distances, parcel codes and zones."""
    p = table(spark, d, "places")
    n = F.substring("id", 2, 12).cast("int")
    zone = F.concat(F.lit("도시지역 "), F.element_at(F.array(*(F.lit(z) for z in ["준주거지역", "제2종일반주거지역", "일반상업지역", "준공업지역", "자연녹지지역", "농림지역"])), n % 6 + 1))
    return p.select("id", F.round(S.distance_m(c("lat"), c("lng"), F.lit(37.2), F.lit(127.25)), 3).alias("metres"), S.parcel_code((n % 90000 + 10000).cast("string"), (n % 400).cast("string"), n % 7 == 0, n % 1000, F.when(n % 2 == 0, n % 30)).alias("pnu"), S.zone_category(zone).alias("zone"))


P_GEO = oracle(r"""
with t as (select *, substr(id, 2)::int as n, sin(radians(37.2 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(37.2)) * sin(radians(127.25 - lng) / 2) ** 2 as a from places)
select id, round(2 * 6371000.0 * asin(least(1.0, sqrt(a))), 3) as metres, lpad((n % 90000 + 10000)::varchar, 5, '0') || lpad((n % 400)::varchar, 5, '0') || case when n % 7 = 0 then '2' else '1' end || lpad((n % 1000)::varchar, 4, '0') || lpad(case when n % 2 = 0 then n % 30 else 0 end::varchar, 4, '0') as pnu,
  ['준주거지역', '주거지역', '상업지역', '준공업지역', '녹지지역', null][n % 6 + 1] as zone from t""")


def p_names(spark, d):
    """Compatibility forms and brand spellings unified."""
    it = table(spark, d, "items")
    wide = F.translate("address", "0123456789", "０１２３４５６７８９")
    return it.select("seq", S.canonical_name(nfkc(wide)).alias("name"))


P_NAMES = oracle(r"""select seq, replace(replace(replace(replace(lower(regexp_replace(address, '[\s\-_()·,.]', '', 'g')), '이편한세상', 'e편한세상'), '에스케이', 'sk'), '케이비', 'kb'), '엘에이치', 'lh') as name from items""")

def p_uses(spark, d):
    """Uses that register texts name, and labels of insurance histories."""
    it = table(spark, d, "items")
    k = c("seq") % 4
    text = F.concat(F.when(k == 0, "공부상 용도는 근린생활시설이며 ").when(k == 1, "현황 다세대주택 사무소로 등재됨 ").otherwise("주변에 사무실 밀집 "), F.lit("전유부 3층 "), F.when(c("seq") % 3 == 0, "제2종근린 점포").when(c("seq") % 3 == 1, c("usage_name")).otherwise("기타"), F.when(c("seq") % 5 != 0, " 공용부 계단 주택").otherwise(" 소유자 주택"), F.repeat(F.lit(" 끝"), 20))
    v = F.to_json(F.struct((c("seq") % 3).alias("myAccidentCnt"), F.when(c("seq") % 2 == 0, c("appraisal_price")).alias("myAccidentCost"), (c("seq") % 2).alias("otherAccidentCnt"), (c("seq") * 15000).alias("otherAccidentCost"), (c("seq") % 7).alias("business"), (c("seq") % 11 - 9).alias("loan")))
    x = it.select("seq", text.alias("t"), F.when(c("seq") % 13 != 0, v).alias("v")).withColumn("l", S.insurance_labels(c("v")))
    return x.select("seq", S.nonresidential_sign(c("t")).alias("sign"), S.unit_use(c("t")).alias("unit"), c("l.own").alias("own"), c("l.other").alias("other"), c("l.use").alias("use"))


P_USES = oracle(r"""with x as (select seq, usage_name, appraisal_price as a, seq % 13 <> 0 as has from items)
select seq, case seq % 4 when 0 then '공부상 용도는 근린생활시설' when 1 then '사무소로 등재' end as sign,
  case when seq % 3 = 0 then 'NONRES' when seq % 3 = 1 and regexp_matches(usage_name, '다세대주택|연립주택|아파트|오피스텔|주택') then 'RES' when seq % 3 = 1 and regexp_matches(usage_name, '근린생활시설|사무소|점포') then 'NONRES' else 'UNCLEAR' end as unit,
  case when has and seq % 3 > 0 then seq % 3 || '회·' || case when seq % 2 = 0 then round_even(a / 10000, 0)::bigint else 0 end || '만원' else '없음' end as own,
  case when has and seq % 2 > 0 then seq % 2 || '회·' || round_even(seq * 15000 / 10000, 0)::bigint || '만원' else '없음' end as other,
  case when has and (seq % 7 > 0 or seq % 11 > 9) then concat_ws('/', case when seq % 7 > 0 then '영업용' end, case when seq % 11 > 9 then '대여용' end) else '없음' end as use from x""")

QUERIES = {f.__name__: f for f in (p_kinds, p_rights_text, p_areas, p_addresses, p_cases, p_vehicles, p_web, p_geo, p_names, p_uses)}
ORACLES = {"p_kinds": P_KINDS, "p_rights_text": P_RIGHTS_TEXT, "p_areas": P_AREAS, "p_addresses": P_ADDRESSES, "p_cases": P_CASES, "p_vehicles": P_VEHICLES, "p_web": P_WEB, "p_geo": P_GEO, "p_names": P_NAMES, "p_uses": P_USES}
