"""Hand-worked cases of scalar functions, rights, payouts and upkeep."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lotspark.functions import scalar as S
from lotspark.functions.helpers import lcs_length
from lotspark.operators import geo, grading, payout, ranking, rights, search, text, trades, upkeep
from lotspark.operators.substrings import containing
from lotspark.sources import months, versions
from lotspark.sources.versions import KeyedTable

D = dt.date.fromisoformat
M = 1_000_000


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, kind", [("다세대주택", "빌라"), ("연립주택", "빌라"), ("오피스텔", None), ("근린생활시설", None), ("도시형 생활주택", "도시형생활주택"), ("다가구(상가주택)", "상가주택"), (None, None)])
def test_home_kind(spark, raw, kind):
    assert one(spark, S.home_kind(F.col("t").cast("string")), t=raw) == kind


@pytest.mark.parametrize("raw, kind", [("근저당권설정", "mortgage"), ("담보가등기", "security"), ("가압류", "prov_seizure"), ("압 류", "seizure"), ("소유권이전", "ownership"), ("소유권이전청구권가등기", "ownership_prov"), ("뭔가", None)])
def test_right_kind(spark, raw, kind):
    assert one(spark, S.right_kind(F.col("t")), t=raw) == kind


@pytest.mark.parametrize("raw, day", [("2021년 3월 10일", "2021-03-10"), ("2021.03.10", "2021-03-10"), ("2022년6월20일 제45678호", "2022-06-20"), ("20210310", "2021-03-10"), ("2021-02-30", None), ("", None)])
def test_date(spark, raw, day):
    assert one(spark, S.date_kr(F.col("t")), t=raw) == (D(day) if day else None)


@pytest.mark.parametrize("raw, won", [("금500,000,000원", 500 * M), ("1억2,000만원", 120 * M), ("2020년 4월 1일 제11111호", 0), ("채권최고액 금 50,000원", 50_000), ("", 0)])
def test_amount(spark, raw, won):
    assert one(spark, S.amount_kr(F.col("t")), t=raw) == won


def test_address_and_names(spark):
    a = "부산 강서구 강서로 12 (건물, 화곡동)"
    assert tuple(one(spark, S.address_parts(F.col("a")), a=a)) == ("부산광역시", "강서구", "화곡동")
    assert tuple(one(spark, S.address_parts(F.col("a")), a="화성시 동탄면 1")) == ("경기도", "화성시", "동탄면")
    assert tuple(one(spark, S.address_parts(F.col("a")), a="")) == (None, "", "")
    assert one(spark, S.building_prefix(F.col("a")), a="서울 중구 용전리 696 한빛 105동 17층1704호") == "서울 중구 용전리 696 한빛"
    assert [one(spark, S.masked_name(F.col("a")), a=n) for n in ("지희수", "김민", "한국은행", "박")] == ["지○수", "김○", "한국은행", "○"]
    assert one(spark, S.won_text(F.col("n")), n=653_000_000) == "6억 5,300만원"
    assert one(spark, S.plain_model(F.col("a"), F.col("b")), a="K9기아자동차", b="기아자동차") == "K9"
    assert one(spark, S.floor_signed(F.col("a")), a="지하2층") == -2


def rights_of(spark, rows):
    return spark.createDataFrame(rows, "lot int, seq int, kind string, reg_date date, amount long, whole boolean, demanded boolean, note string")


def tenants_of(spark, rows):
    return spark.createDataFrame(rows, "lot int, seq int, move_in date, fixed date, deposit long, demanded boolean")


def test_rights_cases(spark):
    r = rights_of(spark, [
        (1, 1, "mortgage", D("2021-03-10"), 1, False, False, ""), (1, 2, "prov_seizure", D("2023-08-01"), 1, False, False, ""), (1, 3, "auction_start", D("2024-01-05"), 0, False, False, ""),
        (2, 1, "mortgage", D("2022-06-20"), 1, False, False, ""),
        (3, 1, "ownership_prov", D("2020-04-01"), 0, False, False, ""), (3, 2, "mortgage", D("2021-09-15"), 1, False, False, ""),
        (4, 1, "mortgage", D("2021-01-01"), 1, False, False, ""), (4, 2, "mortgage", D("2021-01-01"), 2, False, False, ""),
        (5, 1, "surface", D("2021-01-01"), 5, False, False, ""),
        (6, 1, "mortgage", D("2021-01-01"), 1, False, False, ""), (6, 2, "injunction", D("2022-01-01"), 0, False, False, "건물철거"),
    ])
    t = tenants_of(spark, [(1, 1, D("2022-05-01"), None, 10, False), (2, 1, D("2021-11-01"), None, 180 * M, False), (5, 1, D("2022-01-01"), None, 7, True)])
    risk = {x.lot: (x.assumed, x.risk) for x in rights.analyse(r, t).collect()}
    assert risk == {1: (0, "안전"), 2: (180 * M, "위험"), 3: (0, "위험"), 4: (0, "안전"), 5: (5, "위험"), 6: (0, "위험")}
    verdicts = {(x.lot, x.seq): x.verdict for x in rights.judge_rights(r).collect()}
    assert verdicts[1, 1] == "말소기준권리" and verdicts[1, 2] == "소멸" and verdicts[4, 2] == "소멸" and verdicts[5, 1] == "인수" and verdicts[6, 2] == "인수"
    reasons = {x.lot: x.reasons for x in rights.screened(r).collect()}
    assert reasons[3] == ["senior_ownership_registration"] and reasons[1] == []


def test_payout_cases(spark):
    r = rights_of(spark, [
        (1, 1, "mortgage", D("2024-03-10"), 80 * M, False, False, ""), (2, 1, "mortgage", D("2024-03-10"), 80 * M, False, False, ""),
        (3, 1, "mortgage", D("2022-06-20"), 150 * M, False, False, ""), (4, 1, "seizure", D("2022-01-01"), 60 * M, False, False, ""), (4, 2, "prov_seizure", D("2022-02-01"), 40 * M, False, False, ""),
    ])
    t = tenants_of(spark, [
        (1, 1, D("2024-04-01"), D("2024-05-01"), 60 * M, True), (2, 1, D("2024-04-01"), None, 60 * M, True), (2, 2, D("2024-04-01"), None, 30 * M, True), (3, 1, D("2021-11-01"), D("2021-11-01"), 180 * M, True),
    ])
    base = rights.baselines(r).select("lot", "base_date")
    lots = spark.createDataFrame([(1, 100 * M, "other"), (2, 40 * M, "other"), (3, 150 * M, "other"), (4, 100 * M, "other")], "lot int, fund long, region string").join(base, "lot", "left")
    payouts, recovered, totals = payout.distribute(lots, t, payout.claims_of(r, t), payout.limit_table(spark))
    paid = {(x.lot, x.stage, x.seq): x.paid for x in payouts.collect()}
    assert paid[1, "small", 1] == 25 * M and paid[1, "priority", 1] == 75 * M
    assert paid[2, "small", 1] == paid[2, "small", 2] == 10 * M and paid[2, "priority", 1] == 20 * M
    assert paid[3, "priority", 1_000_001] == 150 * M and (3, "priority", 1) not in paid
    assert paid[4, "general", 1] == 60 * M and paid[4, "general", 2] == 40 * M
    assert {(x.lot, x.seq): x.assumes for x in recovered.collect()} == {(1, 1): 0, (2, 1): 0, (2, 2): 0, (3, 1): 30 * M}
    assert all(x.paid + x.leftover == x.fund and x.paid <= x.fund for x in totals.collect())


def test_limits(spark):
    lots = spark.createDataFrame([(1, "other", D("2024-01-01")), (2, "seoul", D("2020-01-01")), (3, "seoul", None), (4, "seoul", D("2001-01-01"))], "lot int, region string, base_date date")
    got = {x.lot: (x.max_deposit, x.max_priority) for x in payout.with_limits(lots, payout.limit_table(spark)).collect()}
    assert got == {1: (75 * M, 25 * M), 2: (110 * M, 37 * M), 3: (110 * M, 37 * M), 4: (110 * M, 37 * M)}


def test_payouts_keep_within_fund_and_claims(spark):
    from lotspark.plans import q_rights

    from .compare import SF

    t = q_rights._paid(spark, SF)
    assert t[2].where("paid > fund or leftover < 0 or paid + leftover <> fund").count() == 0
    assert t[0].where("paid < 0").count() == 0


def test_near_pairs_equal_brute_force(spark):
    import math
    import random

    random.seed(3)
    pts = [(i, 37 + random.random() / 20, 127 + random.random() / 20) for i in range(120)]
    df = spark.createDataFrame(pts, "id int, lat double, lng double")
    got = {(r.a.id, r.b.id) for r in geo.near_pairs(df, df, 700.0).collect()}

    def metres(p, q):
        h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    assert got == {(p[0], q[0]) for p in pts for q in pts if metres(p, q) <= 700}


def test_search_rules(spark):
    rows = [("a", "부산 해운대구 1", "현황", "신건", "2024-1", ""), ("b", "대구광역시 달서구 2", "백데이터", "매각 (80%)", "2020-31", "유치권"), ("c", "대구 중구 3", "현황", "유찰 1회", "2024-31", "유치권")]
    df = spark.createDataFrame(rows, "item_key string, address string, data_class string, result string, case_no string, tags string")
    keys = lambda **kw: sorted(r.item_key for r in search.search(df, search.Search(**kw)).collect())
    assert keys(province="대구광역시") == ["c"] and keys(province="대구광역시", status="종결물건") == ["b"]
    assert keys(case_no="31", status="신건") == ["b", "c"] and keys(tags=["유치권 제외"]) == ["a"] and keys(regions=["부산 해운대구", "대구 중구"]) == ["a", "c"]


def test_grades(spark):
    df = spark.createDataFrame([(1, 100 * M, 60 * M, 50 * M), (2, 100 * M, 80 * M, 90 * M), (3, 100 * M, 120 * M, 1), (4, None, 1, 1), (5, 5, 0, 0)], "id int, price long, expected long, minimum long")
    assert {r.id: r.grade for r in grading.buy_grade(df).collect()} == {1: "good", 2: "review", 3: "ban", 4: "ban"}


def test_lcs_and_register(spark):
    assert lcs_length("금호서한이다음", "금호신도시서한이다음") == 7 and lcs_length("", "a") == 0 and lcs_length("abc", "xyz") == 0
    names = spark.createDataFrame([(1, "d", "금호서한이다음"), (2, "d", "편한세상"), (3, "d", "같은 이름")], "id int, district string, name string")
    reg = spark.createDataFrame([(10, "d", "금호신도시서한이다음"), (11, "d", "율하이편한세상아파트"), (12, "d", "같은이름")], "code int, district string, name string")
    assert {r.id: r.code for r in trades.match_register(names, reg).collect()} == {1: 10, 3: 12}


def _labels(spark, edges, save):
    return {r.node: r.component for r in geo.components(edges, save).collect()}


@pytest.mark.parametrize("spread, n", [(0.004, 250), (0.02, 400), (0.06, 500)])
def test_adjoining_equals_all_pairs(spark, spread, n):
    from lotspark.sources.scratch import saver

    rng, save = random.Random(n), saver(spark)
    spots = [(37 + rng.random() * spread, 127 + rng.random() * spread) for _ in range(n)]
    spots += spots[:20] + [(59.9 + rng.random() * spread, -1 + rng.random() * spread) for _ in range(n // 4)]
    p = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)] + [(10_000, None, 127.0), (10_001, 37.0, None)], "parcel long, lat double, lng double")
    pairs = geo.near_pairs(p, p, 150.0).where("a.parcel < b.parcel").select(F.col("a.parcel").alias("src"), F.col("b.parcel").alias("dst"))
    assert _labels(spark, geo.adjoining(p, 150.0, save), save) == _labels(spark, pairs, save)


def test_adjoining_near_misses(spark):
    """Rings of points around a centre, just inside and just outside of reach: outermost points decide nothing alone."""
    import math

    from lotspark.sources.scratch import saver

    save, deg = saver(spark), 1 / 111_194.93
    for metres, linked in ((149.9, True), (150.1, False)):
        spots = [(0.0, 0.0)] + [(metres * deg * math.sin(t / 50), metres * deg * math.cos(t / 50)) for t in range(3)]
        p = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "parcel long, lat double, lng double")
        assert (0 in _labels(spark, geo.adjoining(p, 150.0, save), save)) is linked


def test_adjoining_of_a_dense_cell(spark):
    """100,000 points within one cell and as many in the next make a star each, not pairs."""
    from lotspark.sources.scratch import saver

    save = saver(spark)
    lat = lambda base: (F.lit(base) + F.col("id") % 317 * 1e-6).alias("lat")
    lng = (F.lit(127.0) + F.col("id") % 313 * 1e-6).alias("lng")
    p = spark.range(100_000).select(F.col("id").alias("parcel"), lat(37.0), lng).union(spark.range(100_000).select(F.col("id") + 100_000, lat(37.0012), lng))
    edges = save(geo.adjoining(p, 150.0, save))
    assert edges.count() < 250_000
    assert geo.components(edges, save).groupBy("component").count().collect() == [(0, 200_000)]


def test_trade_area_takes_the_largest_area(spark):
    from lotspark.sources.scratch import saver

    lots = spark.createDataFrame([(1, 37.0, 127.0)], "id long, lat double, lng double")
    spots = [(1, 37.004, 127.0, 10), (2, 37.0041, 127.0, 10), (3, 36.996, 127.0, 50)]
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    for columns, component in ((["parcel", "lat", "lng", "area"], 3), (["parcel", "lat", "lng"], 1)):
        p = spark.createDataFrame(spots, "parcel long, lat double, lng double, area long").select(columns)
        assert geo.trade_area(lots, p, edges, saver(spark)).first().component == component


def test_components(spark):
    from lotspark.sources.scratch import saver

    chain = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in geo.components(spark.createDataFrame(chain, "src long, dst long"), saver(spark)).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[101] == 100


def test_upsert_and_diff(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, views int")
    new = spark.createDataFrame([(2, "B", 0), (3, None, 1)], "k int, v string, views int")
    assert sorted(map(tuple, upkeep.upsert(old, new, "k", keep=("views",)).collect())) == [(1, "a", 5), (2, "B", 6), (3, None, 1)]


def test_titles_greedy(spark):
    from lotspark.sources.scratch import saver

    news = spark.createDataFrame([(1, 0, "서울 아파트 값 상승"), (2, 0, "서울 아파트 전세"), (3, 0, "아파트 서울 값 하락"), (4, 1, "서울 아파트 값 상승")], "k int, day int, title string")
    pairs = text.duplicate_pairs(news, "k", "day", "title")
    assert sorted(r.k for r in text.first_kept(news, pairs, "k", "day", saver(spark)).collect()) == [1, 4]


def test_duplicate_titles_equal_all_pairs(spark):
    draw = random.Random(11)
    title = lambda: " ".join(draw.choices(["값", "상승", "서울", "아파트", *(f"w{i}" for i in range(12))], [1, 9, 9, 9, *[1] * 12], k=draw.randint(0, 9)))
    rows = [(k, draw.choice([0, 1, None]), draw.choice([None, title(), title(), title()])) for k in [*range(120), 7, 7, None]]
    words = [(k, d, {w for w in (t or "").split() if len(w) > 1}) for k, d, t in rows]
    want = {
        (d, *sorted((k, m))) for k, d, v in words for m, e, w in words
        if k is not None and m is not None and k != m and d is not None and d == e and len(v & w) >= 2 and 2 * len(v & w) >= min(len(v), len(w))
    }
    news = spark.createDataFrame(rows, "k int, day int, title string").withColumn("w", F.lit(1)).withColumn("n", F.lit("x"))
    got = [tuple(r) for r in text.duplicate_pairs(news, "k", "day", "title").collect()]
    assert sorted(got) == sorted(want) and want


def test_kept_titles_equal_the_greedy_order(spark):
    from lotspark.sources.scratch import saver

    draw = random.Random(5)
    nodes = [(k, day) for day in (0, 1, None) for k in range(40)]
    edges = sorted({(day, *sorted(draw.sample(range(40), 2))) for day in (0, 1) for _ in range(60)} | {(0, k, k + 1) for k in range(12)})
    want = []
    for day in (0, 1):
        kept = set()
        for k in range(40):
            if not any((day, a, k) in edges for a in kept):
                kept.add(k)
        want += [(day, k) for k in sorted(kept)]
    news, pairs = spark.createDataFrame(nodes, "k int, day int"), spark.createDataFrame(edges, "day int, a int, b int")
    got = text.first_kept(news, pairs, "k", "day", saver(spark)).collect()
    assert sorted(map(tuple, (r for r in got if r.day is not None))) == want
    assert sorted(r.k for r in got if r.day is None) == list(range(40))
    assert text.first_kept(news.limit(0), pairs.limit(0), "k", "day", saver(spark)).count() == 0


def test_register_compares_spellings_once(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("가나다라마") for _ in range(draw.randint(0, 9)))
    names, reg = [(i, i % 3, word()) for i in range(60)], [(i, i % 3, word()) for i in range(90)]
    got = trades.match_register(spark.createDataFrame(names, "id int, district int, name string"), spark.createDataFrame(reg, "code int, district int, name string"))

    def best(district, a):
        found = []
        for code, d, b in reg:
            if d == district and a and b:
                inside, l = a in b or b in a, lcs_length(a, b)
                score = 1000 if a == b else 500 - abs(len(a) - len(b)) if inside else 300 + l / len(a) * 100 - abs(len(a) - len(b)) * 0.5
                if inside or l >= max(4, 0.7 * len(a)):
                    found.append((-score, code, a == b or (min(len(a), len(b)) if inside else l) >= 0.6 * len(b)))
        return (min(found)[1], round(-min(found)[0], 6)) if found and min(found)[2] else None

    want = {i: best(d, a) for i, d, a in names}
    assert {r.id: (r.code, r.score) for r in got.collect()} == {i: b for i, b in want.items() if b}


def test_stream_equals_batch(spark, tmp_path):
    from lotspark.streaming import feeds

    rows = [(i % 7, i, f"v{i}") for i in range(40)]
    schema = "k int, version int, v string"
    for n in range(4):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.change_feed(spark, str(tmp_path / "in"), schema)
    out = KeyedTable(spark, str(tmp_path / "out"), "k", schema, 4)
    feeds.run_once(stream, str(tmp_path / "ck"), feeds.upsert_into(out, "version"))
    got = sorted(map(tuple, out.read().select("k", "version", "v").collect()))
    assert got == sorted(map(tuple, upkeep.latest(spark.createDataFrame(rows, schema), "k", "version").select("k", "version", "v").collect()))


def test_windowed_counts(spark, tmp_path):
    from lotspark.streaming import feeds

    from .compare import SF

    batch = feeds.counts_by_window(spark.read.parquet(f"{SF}/events.parquet"), "ts", "event_type")
    stream = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = feeds.counts_by_window(stream, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("usage, group", [("G80", None), ("K5", None), ("디스커버리 4", None), ("에쿠스", None), ("SM6", None), ("다세대주택", "다세대연립"), ("아파트", "아파트"), ("근린상가", "상가"), ("대지", None)])
def test_map_groups_without_vehicles(spark, usage, group):
    assert one(spark, S.map_group(F.lit("auction"), F.col("t")), t=usage) == group


@pytest.mark.parametrize("model, body", [("그랜드체로키", "SUV"), ("아테온", "승용자동차"), ("ARTEON x1", "승용자동차"), ("Land Cruiser", "SUV"), ("SUV", "SUV"), ("캐스퍼", "SUV"), ("K5", "승용자동차")])
def test_body_types(spark, model, body):
    assert one(spark, S.body_type(F.col("t")), t=model) == body


def test_class_words_match_no_ad(spark):
    from lotspark.operators import vehicles

    words = ["승합자동차", "해치백", "쿠페", "왜건", "밴", "경형", "소형", "중형", "대형", "지게차", "굴삭기", "덤프", "탱크로리", "특수자동차", "화물자동차", "모닝"]
    t = spark.createDataFrame([(i, [w], 2020, "petrol", 1000, None) for i, w in enumerate(words)], "id int, terms array<string>, year int, fuel string, mileage long, litre double")
    a = spark.createDataFrame([(1, " ".join(words), 2021, "petrol", 5999, 10), (2, " ".join(words), 2022, "petrol", 1000, 10), (3, " ".join(words), 2020, "petrol", 6001, 10)], "ad int, text string, year int, fuel string, mileage long, price long")
    assert [tuple(r) for r in vehicles.match_ads(t, a).collect()] == [(len(words) - 1, 1, 10, False)]


def test_detail_fields(spark):
    body = """머리말
물건현황/토지이용계획
 도로 접함
제 2 종 일반주거지역

감정평가현황
가격시점
2025-03-04
면적(단위:m²)
대지권
13,449.5㎡
분의
41.95㎡
(12.69평)
건물
84.9㎡
(25.7평)
건축물대장
등기사항/소멸여부
건물열람
2025-05-06
소유권이전
2020-01-02
집합
상속 등 기 원 인
홍길동
이전
감정평가현황"""
    df = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "등기사항/소멸여부\n소유권보존\n홍길동")], "id int, body string")
    got = {r.id: r.f.asDict(True) for r in text.detail_fields(df, "body").select("id", F.col("detail").alias("f")).collect()}
    assert got[1] == {
        "bullets": ["도로 접함", "제 2 종 일반주거지역"], "zone": "제 2 종 일반주거지역", "price_date": "2025-03-04", "land": ["13,449.5㎡ 분의 41.95㎡ (12.69평)"], "building": ["84.9㎡ (25.7평)"],
        "view_date": "2025-05-06", "owner": {"type": "소유권이전", "date": "2020-01-02", "holder": "홍길동", "reason": "상속", "state": "이전", "object": "집합"},
    }
    empty = {"bullets": [], "zone": "", "price_date": "", "land": [], "building": [], "view_date": "", "owner": None}
    assert got[2] == got[3] == empty
    assert got[4] == empty | {"owner": {"type": "소유권보존", "date": "", "holder": "", "reason": "", "state": "이전", "object": ""}}


def test_longest_sections(spark):
    df = spark.createDataFrame([(1, "1) ab\n2) x\n1)  a   b c \n9) long enough\n1) a b d")], "id int, body string")
    assert [tuple(r) for r in text.longest_sections(df, "id", "body", r"(\d+)\) ([^\n]*)", [1, 2]).collect()] == [(1, 1, "a b c")]


def test_no_data_marks(spark):
    now, old = F.lit(dt.datetime(2024, 1, 10)), [(1, dt.datetime(2024, 1, 8)), (2, dt.datetime(2024, 1, 6))]
    marks, targets = spark.createDataFrame(old, "k int, ts timestamp"), spark.range(20).select(F.col("id").cast("int").alias("k"))
    turn = [0]

    def job(open_):
        turn[0] += 1
        keys = sorted(r.k for r in open_.collect())
        return spark.createDataFrame([(k, k % 2 == 0, turn[0]) for k in keys[:1]], "k int, found boolean, turn int")

    got = {r.k: r.turn for r in upkeep.until_covered(targets, job, "k", marks, now).collect()}
    assert got == {0: 1, 2: 2, 3: 3}  # 1 is marked, 3 has nothing and ends it


def test_facets_replace_and_typed_read(spark, tmp_path):
    from lotspark.sources import tables

    path = f"file://{tmp_path}/facets"
    for n in (3, 2):
        tables.write_facets(spark.range(n).select("id", F.array("id").alias("a")), path)
        assert versions.read(spark, path).count() == n
    versions.sweep(spark, path)
    assert len([p for p in (tmp_path / "facets").iterdir() if p.name[0] != "."]) == 2 and versions.read(spark, path).count() == 2
    spark.createDataFrame([("s", 1)], "sgg string, extra int").write.parquet(f"{tmp_path}/t")
    read = tables.read(spark, "trades", f"{tmp_path}/t")
    assert read.columns[0] == "sgg" and "extra" not in read.columns and read.first().amount is None


def test_unsent_links(spark, tmp_path):
    from lotspark.streaming import feeds

    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "link string, ts string").write.parquet(f"{tmp_path}/in")
    sent = []
    feeds.run_once(feeds.unsent(feeds.change_feed(spark, f"{tmp_path}/in", "link string, ts string"), "link", "ts"), f"{tmp_path}/check", lambda batch, _: sent.extend(r.link for r in batch.collect()))
    assert sorted(sent) == ["a", "b"]


def test_latitudes_beyond_the_grid(spark):
    far = spark.createDataFrame([(1, 70.0, 10.0)], "id int, lat double, lng double")
    assert geo.near_pairs(far, far, 500.0, max_lat=75.0).count() == 1
    with pytest.raises(Exception, match="latitude"):
        geo.near_pairs(far, far, 500.0).collect()


def files(spark, table):
    return set(table.read().inputFiles())


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k", "k string, version int, v string", 16)
    assert t.read().count() == 0
    t.upsert(spark.range(1000).selectExpr("concat('k', id) as k", "1 as version", "concat('a', id) as v"))
    before = files(spark, t)
    new = spark.createDataFrame([("k5", 2, "new"), ("k5", 3, "newest"), ("k7", 0, "stale"), ("x", 1, "x"), (None, 1, "none")], "k string, version int, v string")
    touched = t.upsert(new, "version", keep=())
    after = files(spark, t)
    assert len(touched) <= 4 and len(before & after) == 16 - len(touched) > 0
    got = {r.k: (r.version, r.v) for r in t.read().collect()}
    assert got["k5"] == (3, "newest") and got["k7"] == (1, "a7") and got["x"] == (1, "x") and len(got) == 1002
    assert t.upsert(new, "version") and {r.k: (r.version, r.v) for r in t.read().collect()} == got  # again changes nothing
    assert t.upsert(new.limit(0)) == []
    with pytest.raises(ValueError):
        KeyedTable(spark, f"file://{tmp_path}/t", "k", "k string, version int, v string", 8).read()
    versions.sweep(spark, f"file://{tmp_path}/t")
    assert {r.k: (r.version, r.v) for r in t.read().collect()} == got


def test_a_stopped_or_late_writer_leaves_the_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    versions.replace(spark.range(3), path)
    with monkeypatch.context() as m:

        def stop(*_):
            raise KeyboardInterrupt

        m.setattr(versions, "commit", stop)
        with pytest.raises(KeyboardInterrupt):
            versions.replace(spark.range(5), path)
    assert versions.read(spark, path).count() == 3
    number, manifest = versions.current(spark, path)
    versions.replace(versions.read(spark, path).union(spark.range(1)), path)  # reads what it replaces
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, manifest, number)
    assert versions.read(spark, path).count() == 4
    versions.sweep(spark, path)
    assert versions.read(spark, path).count() == 4 and len([p for p in (tmp_path / "t").iterdir() if p.name[0] != "."]) == 2


def test_jdbc_ranges(spark):
    """A database that the test keeps in memory: even ranges of uneven keys, all rows once."""
    from lotspark.sources import tables

    from .compare import SF

    url, driver = "jdbc:derby:memory:ranges;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    orders = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("cast(if(o_orderkey % 3 = 0, o_orderkey * o_orderkey, o_orderkey) as bigint) as id", "o_totalprice as price")
    rows = orders.unionByName(spark.createDataFrame([(None, 1.0)], "id long, price double"))
    rows.coalesce(1).write.jdbc(url, "orders_in", properties={"driver": driver})
    back = tables.read_jdbc(spark, url, "orders_in", '"id"', 6, driver=driver)
    parts = [r[0] for r in back.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    assert back.rdd.getNumPartitions() == 6 and max(parts) < 2.5 * rows.count() / 6
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    rows.limit(0).write.jdbc(url, "empty_in", properties={"driver": driver})
    assert tables.read_jdbc(spark, url, "empty_in", '"id"', 6, driver=driver).count() == 0


def test_needles_in_texts(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    texts = [(i % 3, word(rng.randint(0, 30))) for i in range(300)] + [(0, None)]
    needles = [(i % 4, word(rng.randint(0, 6))) for i in range(120)] + [(1, None)]
    t, n = spark.createDataFrame(texts, "g int, text string"), spark.createDataFrame(needles, "g int, needle string")
    want = {(g, x, y) for g, x in texts for h, y in needles if g == h and x is not None and y and y in x}
    assert {tuple(r) for r in containing(t, n, ("g",)).collect()} == want
    whole = {(x, y) for _, x in texts for _, y in needles if x is not None and y and y in x}
    assert {tuple(r) for r in containing(t, n).collect()} == whole
    assert containing(t.limit(0), n, ("g",)).count() == containing(t, n.limit(0)).count() == 0


def test_register_of_one_large_district_equals_all_pairs(spark):
    """Thousands of spellings in one district: what the letters leave out would have had no common subsequence."""
    rng = random.Random(9)
    parts = ["한빛", "푸른", "대우", "래미안", "현대", "신도시", "마을", "1차", "2단지", "아파트", "빌라", "타운", "센트럴", "파크", "e편한"]
    spell = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
    a, b = sorted({spell() for _ in range(300)}), sorted({spell() for _ in range(2500)})
    left = spark.createDataFrame([(1, x) for x in a], "district int, a string")
    right = spark.createDataFrame([(1, x) for x in b], "district int, b string")
    got = {(r.a, r.b) for r in trades.coverable(left, right, "district").collect()}
    want = {(x, y) for x in a for y in b if (n := lcs_length(x, y)) >= 4 and n >= 0.7 * len(x)}
    assert want <= got and len(got) < 0.1 * len(a) * len(b)


def test_stored_matches_win_and_tags_count(spark):
    at = "경기도 수원시 매탄동 12 "
    lots = spark.createDataFrame([(1, at + "한빛 101호"), (2, at + "한빛 102호"), (3, at + "푸른 101호"), (4, at + "한빛 103호"), (5, at + "이름 101호")], "lot int, address string")
    complexes = spark.createDataFrame([(10, "한빛", "", "경기도 수원시 매탄동"), (11, "다른이름", "푸른 마을", "경기도 수원시 매탄동")], "complex_no int, name string, tag string, address string")
    stored = spark.createDataFrame([(1, "77", True), (2, None, False), (4, None, None)], "lot int, complex_no string, region_ok boolean")
    got = {r.lot: (r.complex_no, r.score) for r in trades.match_complexes(lots, complexes, stored=stored).collect()}
    assert got == {1: (77, None), 3: (11, 0.9), 4: (10, 1.0), 5: (11, 1.0)}
    assert {r.lot for r in trades.match_complexes(lots, complexes).collect()} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("address, name", [
    ("서울특별시 강서구 화곡동 12-3 한빛아파트 101동 5층504호", "한빛"), ("경기도 수원시 영통구 매탄동 12외 3필지 래미안 제101동 제5층 제504호", "래미안"), ("서울 종로구 종로5가 1 푸른단지", "서울 종로구 종로5가 1 푸른"),
    ("화성시 동탄면 오산리 7 이편한세상 (화곡동, 한빛) B101호", "이편한세상"), ("강원도 강릉시 교동", "교동"), ("경기도 과천시 테헤란로 12", "12"), ("", None), (None, None), ("대구광역시 달서구 월성동 1 한빛5층 501호", "한빛"), ("부산광역시 중구 동광동3가 5 제2동 상가", None),
])
def test_complex_names(spark, address, name):
    assert one(spark, S.complex_name(F.col("a").cast("string")), a=address) == name


def test_places_over_ranges(spark):
    from lotspark.sources.scratch import saver

    draw = random.Random(5)
    rows = [("hot" if i % 3 else draw.choice([None, "a", "b"]), draw.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, n int, i int")
    got = {(r.g, r.n, r.i): r.place for r in ranking.with_places(df, ["g"], [F.col("n").desc(), F.col("i").asc()], saver(spark)).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {r: at for at, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1)}
    assert got == want
    assert ranking.with_places(df.limit(0), ["g"], [F.col("n").desc()], saver(spark)).count() == 0


def test_medians(spark):
    import statistics

    draw = random.Random(6)
    groups = {g: [draw.randrange(20) for _ in range(n)] for g, n in (("hot", 2001), ("even", 400), ("one", 1), ("two", 2))}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("two", None), (None, 4)]
    got = {r.g: (r.n, r.median) for r in ranking.medians(spark.createDataFrame(rows, "g string, v long"), ["g"], "v").collect()}
    assert got == {g: (len(vs), statistics.median(vs)) for g, vs in groups.items()} | {"none": (1, None), "two": (3, statistics.median(groups["two"])), None: (1, 4.0)}


def test_only_wanted_months_are_read(spark, tmp_path):
    days = [D(f"2023-{m:02d}-15") for m in range(1, 13)]
    path = str(tmp_path / "by-month")
    months.write_months(spark.createDataFrame([(i, d) for i, d in enumerate(days)] + [(99, None)], "i int, day date"), "day", path)
    bases = spark.createDataFrame([(D("2023-06-02"),), (D("2023-06-30"),), (D("2023-11-11"),), (None,)], "base date")
    for folder in (tmp_path / "by-month").iterdir():  # what isn't wanted can't even be read
        if folder.is_dir() and folder.name not in {"ym=202304", "ym=202305", "ym=202306"}:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"no parquet")
    got = months.read_months(spark, path, "i int, day date", bases.where("base < date'2023-07-01'"), 3)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted((r.base, r.i) for r in got.collect()) == [(D("2023-06-01"), i) for i in (3, 4, 5)]
