"""Domain tables derived from the driver's star schema, in SQL that Spark and DuckDB read alike.

Every derived table is a projection or an equi-join of given tables, so work on
it grows with them. The spellings of Korean texts vary by key arithmetic, as they
do in real feeds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")


def _pick(words: str, key: str) -> str:
    n = words.count(",") + 1
    return f"split_part('{words}', ',', cast({key} % {n} as int) + 1)"


USAGES = "아파트,다세대주택,오피스텔,도시형 생활주택,근린상가,다가구주택,연립주택,대지,상가주택,현대 승용차,숙박(여관),생활형 숙박시설"
PLACES = (
    "서울특별시 강서구 화곡동,부산 해운대구 우동,대구광역시 달서구 월성동,인천광역시 남구 주안동,경기도 수원시 영통구 매탄동,"
    "화성시 동탄면 오산리,충남 천안시 신부동,강원도 강릉시 교동,서울 종로구 종로5가,제주시 노형동,경기 과천시 별양동,전라북도 전주시 효자동"
)
NAMES = "한빛아파트,푸른빌라,대우푸르지오,이편한세상,현대타운,에스케이뷰,삼성래미안,금호신도시서한이다음"
COURTS = "A01,A02,B03,C01,D01,E01,F02,G01,H01,I01,J01,L02"
PEOPLE = "김철수,이영,박,한국은행,서울 새마을금고,최민수현"

#: The complex that an address of ``items`` names, told from what it was made of: places that begin with a bare province keep all words.
COMPLEX = (
    f"(case when regexp_matches({_pick(PLACES, 'custkey')}, '^(부산|서울|충남|경기) ') then {_pick(PLACES, 'custkey')} || ' ' || cast(custkey % 97 + 1 as string)"
    f" || case when custkey % 3 = 0 then '-' || cast(custkey % 5 + 1 as string) else '' end || ' ' else '' end || replace({_pick(NAMES, 'custkey')}, '한빛아파트', '한빛'))"
)

#: Table by its SQL. Rows are numbered by ``lot``, not ``l_orderkey``, so that later groups and joins by lot find them dealt by it.
DERIVED: dict[str, str] = {
    "items": f"""
      select o_orderkey as seq,
        {_pick(COURTS, 'o_custkey')} || '|' || substr(cast(o_orderdate as string), 1, 4) || '|' || cast(o_orderkey as string) || '|1' as item_key,
        {_pick(COURTS, 'o_custkey')} as court_code, o_custkey as custkey,
        substr(cast(o_orderdate as string), 1, 4) || '-' || cast(o_orderkey as string) as case_no,
        case when o_orderkey % 5 = 0 then substr(cast(o_orderdate as string), 1, 4) || ' 타경 ' || cast(o_orderkey as string) || ' 물건' end as title,
        {_pick(USAGES, 'o_custkey')} as usage_name,
        {_pick('주거용,주거용,상가,주거용,상가,주거용,주거용,차량외,상가,차량외,상가,상가', 'o_custkey')} as search_group,
        {_pick(PLACES, 'o_custkey')} || ' ' || cast(o_custkey % 97 + 1 as string) || case when o_custkey % 3 = 0 then '-' || cast(o_custkey % 5 + 1 as string) else '' end
          || ' ' || {_pick(NAMES, 'o_custkey')} || case when o_orderkey % 11 = 0 then ' 지하1층B101호' when o_orderkey % 13 = 0 then ' ' || cast((o_orderkey % 15 + 1) * 100 + 2 as string) || '호'
          else ' 10' || cast(o_orderkey % 4 + 1 as string) || '동 ' || cast(o_orderkey % 15 + 1 as string) || '층' || cast((o_orderkey % 15 + 1) * 100 + 4 as string) || '호' end
          || case when o_orderkey % 17 = 0 then ' (화곡동, ' || {_pick(NAMES, 'o_custkey')} || ')' else '' end as address,
        case when o_orderkey % 3 <> 0 then '대지권 12.1㎡, 전용 ' || cast(50 + o_orderkey % 9 as string) || '.5㎡' end as area_text,
        case when o_orderkey % 7 <> 0 then cast(50 + o_orderkey % 9 as string) || '.25㎡ (' || cast(15 + o_orderkey % 3 as string) || '.5평)' end as building_area,
        cast(floor(o_totalprice) as bigint) * 1000 as appraisal_price,
        cast(floor(o_totalprice * (100 - 20 * (o_orderkey % 4)) / 100) as bigint) * 1000 as min_price,
        cast(o_orderkey % 4 as int) as fail_count,
        case when o_orderstatus = 'F' and o_orderkey % 9 <> 0 then cast(floor(o_totalprice * (55 + o_orderkey % 50) / 100) as bigint) * 1000 end as sale_price,
        case when o_orderstatus = 'F' then cast(55 + o_orderkey % 50 as string) || '%' end as sale_rate,
        case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then cast(cast(o_orderdate as date) as string) || ' ' || cast(o_orderkey % 12 + 1 as string) || ' 명 ' || {_pick(PEOPLE, 'o_orderkey')}
          else cast(cast(o_orderdate as date) as string) end as sell_date,
        case when o_orderstatus = 'F' and o_orderkey % 6 <> 1 then '매각 (' || cast(55 + o_orderkey % 50 as string) || '%)' when o_orderstatus = 'F' then '신건 (100%)'
          when o_orderstatus = 'P' then '변경' when o_orderkey % 4 = 0 then '신건' else '유찰 ' || cast(o_orderkey % 4 as string) || '회' end as result,
        case when o_orderstatus = 'F' then '백데이터' else '현황' end as data_class,
        case when o_orderstatus = 'F' then {_pick('매각 2회,취하,잔금납부,배당종결', 'o_orderkey')} end as status_reason,
        case when o_orderkey % 3 = 0 then '유치권' else '' end || case when o_orderkey % 5 = 0 then ' 위반건축물' else '' end || case when o_orderkey % 7 = 0 then ' 지분매각' else '' end as tags,
        case when o_orderkey % 4 <> 3 then cast(floor(o_totalprice * (90 + o_orderkey % 70) / 100) as bigint) * 1000 end as est_price,
        case when o_orderkey % 3 = 1 then cast(o_orderkey % 20 as int) end as bid_count,
        37.0 + (o_custkey % 211) * 0.0023 as lat, 127.0 + (o_custkey % 197) * 0.0029 as lng,
        cast(o_orderdate as date) as sell_day, o_orderstatus as status
      from orders""",
    "rights": f"""
      select lot, row_number() over (partition by lot order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) as seq,
        {_pick('근저당권설정,가압류,소유권이전 청구권 가등기,압 류,전세권설정,임차권 설정,소유권이전,가처분,담보가등기,임의경매개시결정,지상권', '(l_partkey + l_linenumber)')} as purpose,
        cast(l_shipdate as date) as reg_date, cast(floor(l_extendedprice) as bigint) * 1000 as amount,
        l_partkey % 2 = 0 as whole, l_suppkey % 3 <> 0 as demanded, case when l_partkey % 4 = 0 then '건물철거' else '' end as note
      from (select *, l_orderkey as lot from lineitem)""",
    "tenants": """
      select lot, row_number() over (partition by lot order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) as seq,
        case when l_suppkey % 7 <> 0 then cast(l_shipdate as date) + cast(l_partkey % 60 as int) - 40 end as move_in,
        case when l_suppkey % 3 <> 0 then cast(l_shipdate as date) + cast(l_partkey % 90 as int) - 40 end as fixed,
        cast(floor(l_extendedprice) as bigint) * 1000 as deposit, l_returnflag <> 'A' as demanded,
        l_partkey % 5 as occupant
      from (select *, l_orderkey as lot from lineitem) where l_returnflag <> 'N' or l_linenumber = 1""",
    "schedule": """
      select lot, row_number() over (partition by lot order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) as id,
        case when l_returnflag = 'A' then '유찰' when l_returnflag = 'R' then '매각' else '매각 허가' end as result,
        case when l_linestatus = 'F' then cast(floor(l_extendedprice) as bigint) end as sale_price, cast(l_quantity as int) as bid_count,
        cast(l_shipdate as date) as sell_day, case when l_suppkey % 4 <> 0 then 'S' || cast(l_suppkey as string) end as winner_name
      from (select *, l_orderkey as lot from lineitem)""",
    "trades": """
      select l_partkey % 50 as sgg, l_partkey % 400 as umd, cast(l_partkey as string) as jibun, p_name as name, l_quantity as area, l_orderkey % 3 as build_no,
        cast(floor(l_extendedprice) as bigint) * 1000 as amount, cast(l_shipdate as date) as deal_date,
        l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 as trade_id
      from lineitem join part on l_partkey = p_partkey""",
    "lots": """
      select o_orderkey as lot, o_custkey % 50 as sgg, o_custkey % 400 as umd, case when o_orderkey % 3 = 0 then 'none' else cast(o_custkey as string) end as jibun,
        'block ' || cast(o_custkey as string) || ' ' || p_name || ' 3' as address, cast(10 + o_orderkey % 35 as double) as area, cast(o_orderdate as date) as as_of,
        cast(floor(o_totalprice) as bigint) * 1000 as min_price
      from orders join part on o_custkey = p_partkey""",
    "vehicles": """
      select l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 as id, p_brand as maker, p_type || case when l_orderkey % 2 = 0 then p_brand else '' end as model,
        2000 + p_size % 22 as model_year, cast(l_quantity as bigint) * 4000 as mileage, cast(floor(l_extendedprice) as bigint) as price,
        cast(l_shipdate as date) as sell_day, l_linestatus = 'O' as live, cast(l_partkey % 8 as int) as accidents_self, cast(l_suppkey % 3 as int) as accidents_other,
        cast(l_suppkey % 10 as bigint) * 1000000 as damage, case when l_partkey % 6 = 0 then '외판 파손' when l_partkey % 6 = 1 then '누유 흔적 없음' else '' end as note,
        case when l_partkey % 3 = 0 then '가솔린' when l_partkey % 3 = 1 then '경유' else '하이브리드(가솔린+전기)' end as fuel
      from lineitem join part on l_partkey = p_partkey""",
    "places": """
      select 'c' || cast(c_custkey as string) as id, 'customer' as kind, 37.0 + ((c_custkey * 37) % 4001) * 0.00011 as lat, 127.0 + ((c_custkey * 53) % 4001) * 0.00013 as lng,
        cast(c_custkey % 1500 as bigint) as households, c_mktsegment as name from customer
      union all
      select 's' || cast(s_suppkey as string), 'supplier', 37.0 + ((s_suppkey * 41) % 4001) * 0.00011, 127.0 + ((s_suppkey * 59) % 4001) * 0.00013, cast(0 as bigint), 'S' || cast(s_suppkey % 4 as string) from supplier""",
}
NEEDS = {"items": ["orders"], "rights": ["lineitem"], "tenants": ["lineitem"], "schedule": ["lineitem"], "trades": ["lineitem", "part"], "lots": ["orders", "part"], "vehicles": ["lineitem", "part"], "places": ["customer", "supplier"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    given = {n: table(spark, sf_dir, n) for n in NEEDS[name]}
    return spark.sql(re.sub(rf"\b(from|join) ({'|'.join(given)})\b", r"\1 {\2}", DERIVED[name].replace("{", "{{").replace("}", "}}")), **given)


def oracle(sql: str) -> str:
    """DuckDB SQL with the derived tables that it names put in front."""
    used = [n for n in DERIVED if re.search(rf"\b(from|join) {n}\b", sql)]
    ctes = ", ".join(f"{n} as ({DERIVED[n]})" for n in used)
    body = sql.strip()
    if not used:
        return body
    return f"with {ctes}, {body[5:]}" if body.lower().startswith("with ") else f"with {ctes} {body}"
