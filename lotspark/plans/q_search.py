"""Search pages, facets, feeds, upkeep, ledgers and news texts."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar as S
from ..operators import grading, search, text, upkeep
from ..sources import months, tables, versions
from ..sources.driver_tables import oracle, table
from ..sources.scratch import saver, shared_dir
from ..sources.versions import KeyedTable
from ..streaming import feeds
from .q_scalars import P_ADDRESSES


c = F.col
AS_OF = dt.date(1998, 6, 1)


def _items(spark, d):
    return table(spark, d, "items")


def f1_search(spark, d):
    """Ranges, equalities, words of an address and tags."""
    what = search.Search(data_class="현황", equal={"search_group": "상가"}, at_least={"appraisal_price": 50_000_000}, at_most={"min_price": 400_000_000, "fail_count": 2}, known=["est_price"], region="수원시 매탄동", tags=["유치권", "지분매각 제외"])
    return search.search(_items(spark, d), what).select("item_key", "appraisal_price", "min_price")


def f2_regions(spark, d):
    """Several regions, a province by prefix, a group of past statuses and days: past lots are looked at too."""
    what = search.Search(regions=["부산 해운대구", "대구 달서구", "강서구 화곡동"], status="종결물건", sell_from="1996-01-01", sell_to="1999-12-31")
    return search.search(_items(spark, d), what).select("item_key", "result")


def f2_province(spark, d):
    return search.search(_items(spark, d), search.Search(province="대구광역시", status="진행물건")).select("item_key", "address")


def f2_case(spark, d):
    """A case number drops status and days; digits alone match the end."""
    one = search.Search(case_no="1998타경77", status="진행물건", sell_from="2030-01-01")
    two = search.Search(case_no="77", status="유찰")
    it = _items(spark, d)
    return search.search(it, one).select("item_key", F.lit(1).alias("n")).unionByName(search.search(it, two).select("item_key", F.lit(2).alias("n")))


def f3_active(spark, d):
    """Live lots of both feeds in one table."""
    it = _items(spark, d)
    court = it.where((c("sell_day") >= F.lit(AS_OF)) & (c("status") != "F")).select("item_key", "min_price")
    sale = table(spark, d, "orders").where(c("o_orderdate") >= F.lit(dt.date(1998, 9, 1))).select(c("o_orderkey").cast("string").alias("item_key"), F.floor("o_totalprice").cast("long").alias("min_price"))
    return upkeep.two_feeds(("auction", court), ("sale", sale))


def t1_page(spark, d):
    """A page by minimum price, then by sale day."""
    return search.page(_items(spark, d), "minimum_low", "sell_day", limit=20, offset=40).select("item_key", "min_price")


def t1_page_unknown_last(spark, d):
    it = _items(spark, d).withColumn("profit", c("est_price") - c("min_price"))
    return search.page(it, "profit_high", limit=50).select("item_key", "profit")


def a6_status_counts(spark, d):
    return search.status_counts(_items(spark, d), "search_group")


def a7_group_counts(spark, d):
    return _items(spark, d).where("data_class = '현황'").groupBy("search_group").agg(F.count("*").alias("n"))


def a8_region_tree(spark, d):
    return search.region_tree(_items(spark, d))


def a9_facets(spark, d):
    return search.facets(_items(spark, d), "usage_name", "search_group", "court_code", "status", save=saver(spark))


def a10_usages(spark, d):
    return _items(spark, d).where("data_class = '현황'").select("search_group", "usage_name").distinct()


def a21_region_distribution(spark, d):
    it = _items(spark, d).select(S.regulation(c("address")).alias("reg"))
    return it.groupBy("reg").agg(F.count("*").alias("n"))


def a20_coverage(spark, d):
    """Done of target by group: lots with an estimate."""
    it = _items(spark, d)
    g = it.groupBy("search_group").agg(F.count("*").alias("target"), F.count("est_price").alias("done"))
    return g.withColumn("ratio", F.round(c("done") / c("target"), 6))


def s0_favourites(spark, d):
    keys = [r[0] for r in _items(spark, d).where("seq in (5, 3, 11, 7)").select("item_key").orderBy("seq").collect()][::-1]
    return search.in_stated_order(_items(spark, d), [*keys, "none"]).select("pos", "item_key")


def t3_sale_days(spark, d):
    return search.sale_days_around(_items(spark, d), F.lit(AS_OF))


def s2_stale_points(spark, d):
    """Stored points without a live lot, and live lots without a point."""
    it = _items(spark, d)
    live, stored = it.where("status <> 'F'").select("item_key"), it.where("seq % 3 <> 0").select("item_key")
    gone = upkeep.still_to_do(stored, live, "item_key").withColumn("what", F.lit("stale"))
    return gone.unionByName(upkeep.still_to_do(live, stored, "item_key").withColumn("what", F.lit("open")))


def s4_patterns(spark, d):
    it = _items(spark, d)
    return it.where("seq % 2 = 0").select("usage_name").union(it.where("seq % 3 = 0").select("usage_name")).distinct()


def j18_untagged(spark, d):
    """Flagged documents whose lot isn't tagged: audit counts by group."""
    it = _items(spark, d)
    flagged = it.where("seq % 5 = 0 or seq % 7 = 3").select("item_key", "search_group")
    tagged = it.where(c("tags").contains("위반건축물")).select("item_key", F.lit(True).alias("tagged"))
    g = flagged.join(tagged, "item_key", "left").groupBy("search_group").agg(F.count("*").alias("flagged"), F.count_if(c("tagged").isNull()).alias("untagged"))
    return g.withColumn("pct", F.round(c("untagged") * 100 / c("flagged"), 4))


# --- events as changes, ledgers and listings ----------------------------------------------------
def _changes(spark, d):
    e = table(spark, d, "events")
    k = tables.field(c("props"), "k").cast("int")
    return e.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))


HALF = dt.datetime(2024, 1, 16)


def io4_json(spark, d):
    return _changes(spark, d).groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def io5_lookup(spark, d):
    it = _items(spark, d).select("item_key", c("custkey").cast("string").alias("k"))
    cache = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("pool:"), c("c_custkey").cast("string")).alias("cache_key"), c("c_name").alias("data")).unionByName(table(spark, d, "customer").select(F.concat(F.lit("other:"), c("c_custkey").cast("string")).alias("cache_key"), F.lit("no").alias("data")))
    return tables.lookup(it, cache, "k", "pool:").select("item_key", "cached")


def _half(spark, d, late):
    e = _changes(spark, d).where(c("ts") >= F.lit(HALF) if late else c("ts") < F.lit(HALF))
    return upkeep.latest((e.where("user_id % 3 <> 0") if late else e).select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def _ddl(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def io6_upsert(spark, d):
    """The first half of the events written by user in buckets, the second half upserted over it; the first event type is kept."""
    first = _half(spark, d, late=False)
    users = KeyedTable(spark, f"{shared_dir(spark)}/users-{uuid.uuid4().hex}", "user_id", _ddl(first), 8)
    users.upsert(first)
    users.upsert(_half(spark, d, late=True), keep=("event_type",))
    return users.read()


def io7_backfill(spark, d):
    it = _items(spark, d).select("item_key", "est_price", "bid_count")
    v = it.where("bid_count is not null").select("item_key", (c("bid_count") * 1000).cast("long").alias("est_price"))
    return upkeep.backfill(it, v, "item_key")


def io9_months(spark, d):
    """Month partitions that each base date of the orders reads, and the orders in them."""
    o = table(spark, d, "orders").select(c("o_orderkey"), F.date_format("o_orderdate", "yyyyMM").alias("ym"))
    months = table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("base")).distinct().select("base", F.explode(upkeep.months_back(c("base"), 3)).alias("ym"))
    return months.join(o, "ym").groupBy("base").agg(F.count("*").alias("n"))


def io9_partitions(spark, d):
    """Lines shipped in the three months up to each month of late orders, from a table in month partitions."""
    lines = table(spark, d, "lineitem").select("l_orderkey", c("l_quantity").cast("double").alias("l_quantity"), "l_shipdate")
    path = f"{shared_dir(spark)}/shipped-{uuid.uuid4().hex}"
    months.write_months(lines, "l_shipdate", path)
    bases = table(spark, d, "orders").where(c("o_orderdate") >= F.lit(dt.date(1998, 5, 1))).select(c("o_orderdate").cast("date").alias("base"))
    return months.read_months(spark, path, _ddl(lines), bases, 3).groupBy("base").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def io10_split(spark, d):
    return _items(spark, d).select(upkeep.part_of(c("item_key"), 8).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


def io10_sample(spark, d):
    return upkeep.sampled(_items(spark, d).select("item_key"), "item_key", 200, seed=7)


def st1_changes(spark, d):
    e = _changes(spark, d)
    new = upkeep.changed_since(e, F.lit(HALF), "ts")
    return new.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("mark"))


def st1_stream(spark, d):
    """Changes read as a stream that stops and starts again once more have landed: each run sees what is new."""
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    root = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    for landed in (c("ts") < F.lit(HALF), c("ts") >= F.lit(HALF)):
        e.where(landed).write.mode("append").parquet(f"{root}/in")
        feeds.run_once(feeds.change_feed(spark, f"{root}/in", _ddl(e)), f"{root}/mark", feeds.append_batches(f"{root}/out"))
    back = spark.read.schema(f"{_ddl(e)}, batch long").parquet(f"{root}/out")
    return back.groupBy("batch", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("mark"))


def st2_invalidated(spark, d):
    """Result tables to recompute by the fields that changed."""
    e = _changes(spark, d).withColumn("changed_fields", F.array(c("event_type"), F.when(c("k") > 50, "price").otherwise("status")))
    return upkeep.invalidated(e, "user_id", {"bids": ["price", "purchase"], "risk": ["error"], "page": ["status", "price"]}).groupBy("result").agg(F.count("*").alias("users"))


def st3_latest(spark, d):
    """A change feed in three batches, the second one sent twice, upserted one after the other."""
    e = _changes(spark, d).select("user_id", "event_id", "ts", "event_type", "value")
    users = KeyedTable(spark, f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}", "user_id", _ddl(e), 8)
    run = feeds.upsert_into(users, "event_id")
    for n, part in enumerate((0, 1, 1, 2)):
        run(e.where(c("event_id") % 3 == part), n)
    return users.read()


def st_hourly_counts(spark, d):
    """Counts per hour and kind: the batch form of the windowed stream."""
    return feeds.counts_by_window(table(spark, d, "events"), "ts", "event_type")


def st4_snapshot(spark, d):
    """Listings after a crawl of half the groups."""
    e = _changes(spark, d)
    old = e.where(c("ts") < F.lit(HALF)).groupBy(c("event_id").alias("listing")).agg(F.first("user_id").alias("complex"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).withColumn("is_active", F.lit(True))
    now = e.where("user_id % 2 = 0 and event_id % 3 <> 0").select(c("event_id").alias("listing"), c("user_id").alias("complex"))
    return upkeep.snapshot_diff(old, now, "listing", "complex", F.lit(dt.datetime(2024, 2, 1)))


def st5_purge(spark, d):
    e = _changes(spark, d).withColumn("run", c("event_id") % 3)
    return upkeep.purge_unseen(e, F.lit(1), 100).groupBy("run").agg(F.count("*").alias("n")).unionByName(upkeep.purge_unseen(e, F.lit(1), 10_000_000).groupBy("run").agg((F.count("*") * -1).alias("n")))


def f8_open_work(spark, d):
    """Users whose result is missing or older than a week."""
    e = _changes(spark, d)
    now = F.lit(dt.datetime(2024, 1, 31))
    done = upkeep.fresh(e.where("event_type = 'purchase'"), now, 7 * 86400).select("user_id").distinct()
    return upkeep.still_to_do(e.select("user_id").distinct(), done, "user_id")


def st6_until_covered(spark, d):
    """Rounds of a job that covers a quarter of what is open, finds that a twelfth has nothing, and fails for the rest."""
    from ..sources.scratch import saver

    save = saver(spark)
    users = table(spark, d, "events").select("user_id").distinct()
    turn = [0]

    def job(open_):
        turn[0] += 1
        found = c("user_id") % 4 == turn[0] - 1
        return save(open_.where(found | (c("user_id") % 12 == 3)).select("user_id", found.alias("found"), F.lit(turn[0]).alias("round")))

    marks = users.where("user_id % 5 = 0").select("user_id", F.when(c("user_id") % 2 == 0, F.lit(dt.datetime(2024, 1, 29))).otherwise(F.lit(dt.datetime(2024, 1, 27))).alias("ts"))
    return upkeep.until_covered(users, job, "user_id", marks, F.lit(dt.datetime(2024, 1, 31)))


def st7_unsent(spark, d):
    p = table(spark, d, "pages")
    sent = p.where("page_id % 2 = 0").select(S.site_name(c("url")).alias("site")).distinct()
    return upkeep.still_to_do(p.select(S.site_name(c("url")).alias("site")).distinct(), sent, "site")


def st7_stream(spark, d):
    """Links that the second run of a stream sends: those of the first are in its state."""
    p = table(spark, d, "pages").select("page_id", S.site_name(c("url")).alias("site")).where("site is not null")
    links = p.withColumn("ts", F.timestamp_seconds(c("page_id")))
    root = f"{shared_dir(spark)}/links-{uuid.uuid4().hex}"
    for run in (0, 1):
        links.where(c("page_id") % 2 == run).write.mode("append").parquet(f"{root}/in")
        new = feeds.unsent(feeds.change_feed(spark, f"{root}/in", _ddl(links)), "site", "ts", "36500 days")
        feeds.run_once(new, f"{root}/state", feeds.append_batches(f"{root}/sent-{run}"))
    return spark.read.schema(_ddl(links)).parquet(f"{root}/sent-1").select("site")


def w9_ledger(spark, d):
    e = _changes(spark, d).select("event_id", "user_id", F.when(c("event_type") == "purchase", -c("k")).otherwise(c("k") % 7).cast("long").alias("amount"))
    return upkeep.running_balance(e, "user_id", "event_id", "amount")


def w10_membership(spark, d):
    e = _changes(spark, d).where("event_type = 'purchase'").select("user_id", c("ts").cast("date").alias("day"), c("event_id").alias("seq"), (c("k") % 3 + 1).cast("int").alias("months"))
    return upkeep.paid_until(e, "user_id")


W10 = """with recursive p as (select user_id, cast(ts as date) as day, json_extract(props, '$.k')::int % 3 + 1 as months, row_number() over (partition by user_id order by cast(ts as date), event_id) as i from events where event_type = 'purchase'),
f(user_id, i, until) as (select user_id, 1, day + 30 * months from p where i = 1 union all select p.user_id, p.i, greatest(f.until, p.day) + 30 * p.months from f join p on p.user_id = f.user_id and p.i = f.i + 1)
select user_id, max(i) as payments, arg_max(until, i) as until from f group by user_id"""


def j19_members(spark, d):
    """Purchases by grade of customer, customers without one too."""
    cu = table(spark, d, "customer").select(c("c_custkey").alias("user_id"), c("c_mktsegment").alias("grade"))
    e = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))
    return cu.join(e, "user_id", "left").groupBy("grade").agg(F.count("*").alias("members"), F.count("n").alias("payers"), F.coalesce(F.sum("n"), F.lit(0)).alias("payments"))


def j22_specs(spark, d):
    """Lots with their vehicle, and those that lack one."""
    it = _items(spark, d).select("item_key", "seq", "usage_name")
    v = table(spark, d, "vehicles").groupBy(F.floor(c("id") / 1000).cast("long").alias("seq")).agg(F.min("model_year").alias("model_year"), F.max("mileage").alias("mileage"))
    return it.where(c("usage_name").contains("승용차")).join(v, "seq", "left").select("item_key", "model_year", "mileage")


def j15_points(spark, d):
    """Map points of two feeds with today's prices; lots that are gone keep what they had."""
    it, p = _items(spark, d), table(spark, d, "part")
    old = [F.lit(1).cast("long").alias("min_price"), F.lit("old").alias("grade")]
    points = it.where("seq % 4 <> 1").select(F.lit("auction").alias("source"), "item_key", "lat", "lng", *old).unionByName(p.select(F.lit("public").alias("source"), c("p_partkey").cast("string").alias("item_key"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), *old))
    auction = it.where("status <> 'F'").select("item_key", "min_price", F.when(c("seq") % 3 == 0, "good").alias("grade"))
    public = p.where("p_size > 20").select(c("p_partkey").cast("string").alias("item_key"), c("p_size").cast("long").alias("min_price"), F.lit("new").alias("grade"))
    return upkeep.refresh_points(points, auction=auction, public=public)


def j16_zones(spark, d):
    it = _items(spark, d)
    lots = it.select("item_key", F.when(c("seq") % 3 != 0, "주거지역").alias("zone"))
    points = it.where("seq % 2 = 0").select(F.when(c("seq") % 4 == 0, "gongmae").otherwise("auction").alias("source"), "item_key", F.when(c("seq") % 5 != 0, c("lat")).alias("lat"), "lng")
    return upkeep.without_zone(lots, points, "gongmae")


def j17_unsynced(spark, d):
    it = _items(spark, d)
    matches = it.select("item_key", F.when(c("seq") % 3 == 0, "matched").otherwise("none").alias("status"))
    return upkeep.matched_unsynced(matches, it.select("item_key", "address", F.when(c("seq") % 2 == 0, c("sell_day")).alias("synced_at")))


def w12_sections(spark, d):
    """Numbered lines of an order as an appraisal's items."""
    li = table(spark, d, "lineitem")
    line = F.concat(c("l_linenumber") % 4, F.lit(") "), F.repeat(F.lit("x  "), (c("l_quantity") % 7).cast("int")), F.lit(" "), c("l_partkey").cast("string"), F.lit(" "))
    rows = li.groupBy(c("l_orderkey").alias("lot")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return text.longest_sections(rows, "lot", "text", r"(\d+)\) ([^\n]*)", [1, 2, 3])


def io1_typed(spark, d):
    """Rounds written with more columns than the schema states, read by the schema."""
    from ..sources.scratch import saver

    path = saver(spark)(table(spark, d, "schedule").select(c("lot").cast("string").alias("lot"), c("id").cast("long").alias("id"), "result", "sale_price", "bid_count", "winner_name", "sell_day")).inputFiles()[0].rsplit("/", 1)[0]
    return tables.read(spark, "schedule", path)


def io8_facets(spark, d):
    """Nested JSON that replaces an older version, read back."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    cities = n.groupBy(c("r_name").alias("name")).agg(F.array_sort(F.collect_list(F.struct(c("n_name").alias("city"), c("n_nationkey").alias("code")))).alias("cities"))
    path = f"{shared_dir(spark)}/facets-{uuid.uuid4().hex}"
    tables.write_facets(cities.limit(0), path)
    tables.write_facets(cities, path)
    back = versions.read(spark, path, "name string, cities array<struct<city:string,code:long>>")
    return back.select("name", F.size("cities").cast("long").alias("n"), F.array_join(F.transform("cities", lambda x: F.concat(x["city"], F.lit(":"), x["code"])), ",").alias("cities"))


def w6_first_occurrence(spark, d):
    t = table(spark, d, "trades")
    n = F.row_number().over(W.partitionBy("sgg", "umd", "area").orderBy("trade_id", "amount", "deal_date"))
    return t.withColumn("n", n).where("n = 1").select("sgg", "umd", "area", "trade_id", "amount")


def w6b_distinct_points(spark, d):
    return table(spark, d, "places").select(F.bround("lat", 2).alias("lat"), F.bround("lng", 2).alias("lng")).distinct().groupBy("lat").agg(F.count("*").alias("n"))


def w11_main_building(spark, d):
    p = table(spark, d, "part")
    score = c("p_size") * 3 + c("p_partkey") % 9 * 3 + c("p_partkey") % 4 + F.when(c("p_type") == "STANDARD", 100).otherwise(0)
    return p.groupBy((c("p_partkey") % 300).alias("lot")).agg(F.max_by("p_partkey", F.struct(score, -c("p_partkey"))).alias("main"))


# --- texts --------------------------------------------------------------------------------------
def f6_relevance(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    keep = text.relevant(F.lower("text"), ["scum", "###"], [r"license", r"token\s*="], ["the", "der", "que"])
    return docs.select("doc_id", F.coalesce(keep, F.lit(False)).alias("keep"), text.is_ad(c("source"), c("text")).alias("ad"))


def _titles(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", (c("page_id") % 5).alias("day"), S.page_title(c("html")).alias("title"))


def x1_duplicate_titles(spark, d):
    return text.duplicate_pairs(_titles(spark, d), "page_id", "day", "title")


X1 = r"""with t as (select page_id, page_id % 5 as day, coalesce(nullif(regexp_extract(html, '<meta[^>]+property="og:title"[^>]+content="([^"]*)"', 1, 'i'), ''), trim(nullif(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), ''))) as title from pages),
w as (select day, page_id, list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(title, '[·\-|,\[\]"''“”…()]', ' ', 'g'), '\s+'), lambda x: regexp_replace(x, '[^가-힣0-9a-zA-Z]', '', 'g')), lambda x: length(x) >= 2)) as w from t)
select a.day, a.page_id as a, b.page_id as b from w a join w b on a.day = b.day and a.page_id < b.page_id where len(list_intersect(a.w, b.w)) >= 2 and len(list_intersect(a.w, b.w)) >= 0.5 * least(len(a.w), len(b.w))"""


def x1_kept_titles(spark, d):
    from ..sources.scratch import saver

    t = _titles(spark, d)
    return text.first_kept(t, text.duplicate_pairs(t, "page_id", "day", "title"), "page_id", "day", saver(spark))


X1_KEPT = f"""with recursive pairs as materialized ({X1}),
n as (select page_id, page_id % 5 as day, row_number() over (partition by page_id % 5 order by page_id) as i from pages),
b as materialized (select n.day, n.i, n.page_id, coalesce(list(p.a) filter (p.a is not null), []) as before from n left join pairs p on n.day = p.day and n.page_id = p.b group by 1, 2, 3),
f(day, i, kept) as (select distinct day, 0::bigint, []::bigint[] from n
  union all select b.day, b.i, case when list_has_any(f.kept, b.before) then f.kept else list_append(f.kept, b.page_id) end from f join b on b.day = f.day and b.i = f.i + 1)
select day, unnest(arg_max(kept, i)) as k from f group by day"""
#: crc32 of a key's characters, bit by bit.
IO10 = """with k as (select list_prepend(4294967295::bigint, list_transform(string_split(item_key, ''), lambda x: ascii(x)::bigint)) as codes from items),
h as (select list_reduce(codes, lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)) as crc from k)
select (xor(crc, 4294967295) % 8)::int as part, count(*) as n from h group by 1"""


def t6_newest(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    return text.newest_per(e, "event_type", "ts", 3, "event_id").select("event_type", "place", "event_id")


def t7_rounds(spark, d):
    """Rounds of each lot in ascending order, unknown days last."""
    s = table(spark, d, "schedule").withColumn("day", F.when(c("id") % 4 != 3, c("sell_day")))
    return s.withColumn("place", F.row_number().over(W.partitionBy("lot").orderBy(c("day").asc_nulls_last(), "id"))).select("lot", "place", "id")


def p30_sections(spark, d):
    """Lines of a document by the heading above, and the sentence with a word."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    heads = ["Released under the MIT License.", "All rights reserved.", "Licensed under the Apache License, Version 2.0."]
    s = docs.select("doc_id", F.explode(text.sections(F.concat(F.lit(heads[1] + "\n"), c("text")), heads)).alias("s"))
    return s.groupBy("doc_id", c("s.h").alias("head")).agg(F.count("*").alias("lines"), F.sum(F.length("s.l")).alias("chars"))


P30 = """with l as (select doc_id, trim(x, ' ') as x, i from documents, unnest(string_split('All rights reserved.' || chr(10) || text, chr(10))) with ordinality as u(x, i)),
h as (select *, max(case when x in ('Released under the MIT License.', 'All rights reserved.', 'Licensed under the Apache License, Version 2.0.') then i end) over (partition by doc_id order by i) as hi from l where x <> '')
select a.doc_id, b.x as head, count(*) as lines, sum(length(a.x))::bigint as chars from h a join h b on a.doc_id = b.doc_id and a.hi = b.i where a.i <> a.hi group by 1, 2"""


DETAIL_LINES = ["물건현황/토지이용계획", "제2종일반주거지역", "감정평가현황", "가격시점", "등기사항/소멸여부", "소유권이전", "1998-01-02", "매매 등 기 원 인", "보존", "건물", "김철수", "건물열람", "도로"]


def p30_detail(spark, d):
    """Fields of detail texts; every line item of an order adds three lines to the order's text."""
    li = table(spark, d, "lineitem")
    word = lambda n: F.element_at(F.array(*map(F.lit, DETAIL_LINES)), (n % 13 + 1).cast("int"))
    three = F.concat_ws("\n", word(c("l_partkey")), word(c("l_partkey") + c("l_linenumber")), word(c("l_partkey") * 3 + c("l_suppkey")))
    texts = li.groupBy(c("l_orderkey").alias("lot")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", three.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    f = text.detail_fields(texts, "text").select("lot", c("detail").alias("f"))
    return f.select("lot", F.size("f.bullets").cast("long").alias("bullets"), "f.zone", "f.price_date", "f.view_date", *(c(f"f.owner.{x}").alias(f"owner_{x}") for x in ("type", "date", "holder", "reason", "state", "object")))


P30_DETAIL = r"""with w as (select ['물건현황/토지이용계획', '제2종일반주거지역', '감정평가현황', '가격시점', '등기사항/소멸여부', '소유권이전', '1998-01-02', '매매 등 기 원 인', '보존', '건물', '김철수', '건물열람', '도로'] as w),
a as (select l_orderkey as lot, flatten(list([w[l_partkey % 13 + 1], w[(l_partkey + l_linenumber) % 13 + 1], w[(l_partkey * 3 + l_suppkey) % 13 + 1]] order by l_linenumber, l_partkey)) as x from lineitem, w group by 1),
h as (select lot, x, coalesce(list_position(x, '물건현황/토지이용계획'), 0) as a, coalesce(list_position(x, '감정평가현황'), 0) as b, coalesce(list_position(x, '등기사항/소멸여부'), 0) as r, len(x) + 1 as n from a),
s as (select lot, case when a > 0 then x[a + 1 : least(case when b > a then b else n end, case when r > a then r else n end) - 1] else [] end as bs,
  case when b > 0 then x[b + 1 : least(case when a > b then a else n end, case when r > b then r else n end) - 1] else [] end as ps,
  case when r > 0 then x[r + 1 : least(case when a > r then a else n end, case when b > r then b else n end) - 1] else [] end as rs from h),
o as (select *, nullif(list_position(list_transform(rs, lambda y: starts_with(y, '소유권')), true), 0) as o1 from s),
q as (select *, case when o1 is not null then rs[o1 + 1 : o1 + 6] else [] end as six from o),
e as (select *, coalesce(list_position(six, '1998-01-02'), 0) as dt, coalesce(list_position(six, '매매 등 기 원 인'), 0) as why from q)
select lot, len(bs) as bullets, case when list_contains(bs, '제2종일반주거지역') then '제2종일반주거지역' else '' end as zone, coalesce(ps[nullif(list_position(ps, '가격시점'), 0) + 1], '') as price_date,
  coalesce(rs[nullif(list_position(rs, '건물열람'), 0) + 1], '') as view_date, rs[o1] as owner_type, case when o1 is not null then case when dt > 0 then '1998-01-02' else '' end end as owner_date,
  case when o1 is not null then coalesce(case when dt > 0 then list_filter(list_transform(six, lambda y, i: case when i > dt and i <> why and y not in ('보존', '건물') then y end), lambda y: y is not null)[1] end, '') end as owner_holder,
  case when o1 is not null then case when why > 0 then '매매' else '' end end as owner_reason, case when o1 is not null then case when list_contains(six, '보존') then '보존' else '이전' end end as owner_state,
  case when o1 is not null then case when list_contains(six, '건물') then '건물' else '' end end as owner_object from e"""


def p31_waiver(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(text.waiver(c("text"), ["the", "der"], "License")).alias("sentence")).where("sentence is not null")


P31 = r"""with f as (select doc_id, regexp_replace(text, '\s+', ' ', 'g') as t from documents) select doc_id, md5(substr(trim(regexp_extract(t, '([^.]*License[^.]*\.?)', 1)), 1, 240)) as sentence from f where contains(t, 'License') and regexp_matches(t, 'the|der')"""


def io2_trades(spark, d):
    """Landed XML pages of trades, made of line items, parsed back."""
    li = table(spark, d, "lineitem")
    day = c("l_shipdate")
    item = F.concat(
        F.lit("<item><dealAmount> "), F.format_number(F.floor("l_extendedprice"), 0), F.lit("</dealAmount><dealYear>"), F.year(day).cast("string"), F.lit("</dealYear><dealMonth>"), F.month(day).cast("string"), F.lit("</dealMonth><dealDay>"),
        F.when(c("l_linenumber") == 7, "40").otherwise(F.dayofmonth(day).cast("string")), F.lit("</dealDay><excluUseAr>"), c("l_quantity").cast("string"), F.lit("</excluUseAr><umdNm>t"), c("l_suppkey").cast("string"), F.lit("</umdNm><jibun>"), c("l_partkey").cast("string"), F.lit("</jibun><aptNm>n</aptNm></item>"),
    )
    pages = li.groupBy(c("l_orderkey").alias("page")).agg(F.concat(F.lit("<items>"), F.array_join(F.collect_list(item), ""), F.lit("</items>")).alias("body"))
    return tables.parse_trades(pages)


def io3_summary(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(
        c("o_orderkey").cast("string").alias("cltrno"), c("o_custkey").cast("string").alias("pbctno"), (c("o_orderkey") % 4).cast("string").alias("round"), F.format_number(F.floor("o_totalprice"), 0).alias("minimum"), F.format_number(F.floor(c("o_totalprice") * 1.5), 0).alias("appraisal"),
        F.concat(F.lit("동 "), (c("o_orderkey") % 20).cast("string"), F.lit("층 "), (c("o_orderkey") % 900).cast("string"), F.lit("호")).alias("name"), F.when(c("o_orderkey") % 6 != 0, F.date_format("o_orderdate", "yyyyMMddHHmm")).otherwise("bad").alias("closes"),
    )
    return tables.sale_summary(rows)


def r7_multi_family(spark, d):
    p = table(spark, d, "part").select(c("p_partkey").alias("id"), F.when(c("p_partkey") % 5 != 0, c("p_retailprice") * 0.6).alias("area"), c("p_size").alias("units"), (c("p_partkey") % 6).cast("int").alias("floors"))
    return grading.multi_family(p).select("id", "ok_area", "ok_units", "ok_floors", "verdict")


def r8_debt_demand(spark, d):
    o = table(spark, d, "items").select("seq", c("appraisal_price").alias("appraisal"), c("est_price").alias("deposits"), F.when(c("seq") % 2 == 0, c("min_price")).alias("claims"), (c("seq") % 25).alias("units"), (c("seq") % 11).alias("demanding"), (c("seq") % 7).alias("tenants"), c("tags").alias("text"))
    return grading.debt_and_demand(o).select("seq", "debt_ratio", "debt_good", "share", "demand", "violation")


def r11_brief(spark, d):
    p = table(spark, d, "part").select(c("p_partkey").alias("id"), F.when(c("p_partkey") % 3 != 0, c("p_partkey") * 9).alias("r_units"), c("p_size").alias("a_units"), (c("p_partkey") % 4).alias("r_floors"), (c("p_partkey") % 9).alias("a_floors"))
    return grading.merged_brief(p).select("id", "units", "floors")


QUERIES = {
    f.__name__: f
    for f in (
        f1_search, f2_regions, f2_province, f2_case, f3_active, t1_page, t1_page_unknown_last, a6_status_counts, a7_group_counts, a8_region_tree, a9_facets, a10_usages, a21_region_distribution, a20_coverage, s0_favourites, t3_sale_days, s2_stale_points, s4_patterns, j18_untagged,
        io4_json, io5_lookup, io6_upsert, io7_backfill, io9_months, io9_partitions, io10_split, io10_sample, st1_changes, st1_stream, st2_invalidated, st3_latest, st_hourly_counts, st4_snapshot, st5_purge, f8_open_work, j15_points, j16_zones, j17_unsynced, w12_sections, io1_typed, io8_facets, st6_until_covered, st7_unsent, st7_stream, w9_ledger, w10_membership, j19_members, j22_specs, w6_first_occurrence, w6b_distinct_points, w11_main_building,
        f6_relevance, x1_duplicate_titles, x1_kept_titles, t6_newest, t7_rounds, p30_sections, p30_detail, p31_waiver, io2_trades, io3_summary, r7_multi_family, r8_debt_demand, r11_brief,
    )
}
_ACT = "(starts_with(result, '신건') or starts_with(result, '유찰') or starts_with(result, '재진행') or starts_with(result, '재매각'))"
_E = "e as (select event_id, ts, user_id, event_type, value, json_extract(props, '$.k')::int as k from events)"
_HALF = "timestamp '2024-01-16'"
_ST = "case when result = '신건' or starts_with(result, '신건') and not (data_class = '백데이터' and regexp_matches(status_reason, '^(매각|잔금납부|배당|재매각)')) then '신건' when starts_with(result, '신건') then '매각' when starts_with(result, '유찰') then '유찰' when starts_with(result, '매각') then '매각' else '변경' end"
_SITE = "regexp_replace(lower(nullif(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1), '')), '^(www\\.|m\\.)', '')"
_HAS = lambda col, w: f"contains({col}, '{w}')"
ORACLES = {
    "f1_search": oracle("select item_key, appraisal_price, min_price from items where data_class = '현황' and search_group = '상가' and appraisal_price >= 50000000 and min_price <= 400000000 and fail_count <= 2 and est_price is not null and address like '%수원시%' and address like '%매탄동%' and tags like '%유치권%' and tags not like '%지분매각%'"),
    "f2_regions": oracle("select item_key, result from items where ((address like '%부산%' and address like '%해운대구%') or (address like '%대구%' and address like '%달서구%') or (address like '%강서구%' and address like '%화곡동%')) and regexp_matches(result, '^(매각|배당종결|잔금납부|취하|기각|정지|미진행|대금미납|변경|불허)') and sell_day between date '1996-01-01' and date '1999-12-31'"),
    "f2_province": oracle(f"select item_key, address from items where data_class = '현황' and address like '대구%' and {_ACT}"),
    "f2_case": oracle("select item_key, 1 as n from items where case_no = '1998-77' union all select item_key, 2 from items where case_no like '%-77'"),
    "f3_active": oracle("select item_key, min_price, 'auction' as source from items where sell_day >= date '1998-06-01' and status <> 'F' union all select o_orderkey::varchar, floor(o_totalprice)::bigint, 'sale' from orders where o_orderdate >= timestamp '1998-09-01'"),
    "t1_page": oracle("select item_key, min_price from items order by min_price nulls last, sell_day nulls last, item_key limit 20 offset 40"),
    "t1_page_unknown_last": oracle("select item_key, est_price - min_price as profit from items order by est_price - min_price desc nulls last, item_key limit 50"),
    "a6_status_counts": oracle(f"with s as (select {_ST} as status, search_group as kind from items) select case when grouping(status) = 0 then 'status' when grouping(kind) = 0 then 'kind' else 'total' end as level, status, kind, count(*) as n from s group by grouping sets ((status), (kind), ())"),
    "a7_group_counts": oracle("select search_group, count(*) as n from items where data_class = '현황' group by 1"),
    "a8_region_tree": f"with t as ({P_ADDRESSES}) select province, district, town, count(*) as n, grouping(province, district, town)::int as g from t group by rollup (province, district, town) having grouping(province) = 0",
    "a9_facets": oracle("with f as (select 'usage_name' as facet, usage_name as value from items union all select 'search_group', search_group from items union all select 'court_code', court_code from items union all select 'status', status from items), g as (select facet, value, count(*) as n from f group by 1, 2) select *, row_number() over (partition by facet order by n desc, value) as place from g"),
    "a10_usages": oracle("select distinct search_group, usage_name from items where data_class = '현황'"),
    "a21_region_distribution": oracle(f"select case when {' or '.join(_HAS('address', w) for w in S.REGULATED)} then 'regulated' when contains(address, '경기') or contains(address, '인천') then 'metro' else 'none' end as reg, count(*) as n from items group by 1"),
    "a20_coverage": oracle("select search_group, count(*) as target, count(est_price) as done, round(count(est_price) / count(*), 6) as ratio from items group by 1"),
    "s0_favourites": oracle("select (row_number() over (order by seq desc) - 1)::int as pos, item_key from items where seq in (3, 5, 7, 11)"),
    "t3_sale_days": oracle("select min(sell_day) filter (sell_day > date '1998-06-01' and data_class = '현황') as next_day, max(sell_day) filter (sell_day < date '1998-06-01' and starts_with(result, '매각')) as last_day from items"),
    "s2_stale_points": oracle("select item_key, 'stale' as what from items where seq % 3 <> 0 and status = 'F' union all select item_key, 'open' from items where seq % 3 = 0 and status <> 'F'"),
    "s4_patterns": oracle("select distinct usage_name from items where seq % 2 = 0 or seq % 3 = 0"),
    "j18_untagged": oracle("select search_group, count(*) as flagged, count(*) filter (not contains(tags, '위반건축물')) as untagged, round(count(*) filter (not contains(tags, '위반건축물')) * 100 / count(*), 4) as pct from items where seq % 5 = 0 or seq % 7 = 3 group by 1"),
    "io4_json": f"with {_E} select k, count(*) as n, round(sum(value), 4) as total from e group by k",
    "io5_lookup": oracle("select item_key, c_name as cached from items left join customer on custkey = c_custkey and c_custkey % 2 = 0"),
    "io6_upsert": f"""with {_E}, o as (select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id, arg_max(value, event_id) as value from e where ts < {_HALF} group by 1), n as (select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id, arg_max(value, event_id) as value from e where ts >= {_HALF} and user_id % 3 <> 0 group by 1)
      select coalesce(n.user_id, o.user_id) as user_id, coalesce(n.event_id, o.event_id) as event_id, coalesce(o.event_type, n.event_type) as event_type, coalesce(n.value, o.value) as value from o full join n on o.user_id = n.user_id""",
    "io7_backfill": oracle("select item_key, coalesce(bid_count * 1000, est_price)::bigint as est_price, bid_count from items"),
    "io9_months": "with b as (select distinct date_trunc('month', o_orderdate)::date as base from orders) select base, count(*) as n from b join orders on date_trunc('month', o_orderdate)::date between (base - interval 2 month)::date and base group by 1",
    "io9_partitions": "with b as (select distinct date_trunc('month', o_orderdate)::date as base from orders where o_orderdate >= date '1998-05-01') select base, count(*) as n, round(sum(l_quantity), 2)::double as quantity from b join lineitem on date_trunc('month', l_shipdate)::date between (base - interval 2 month)::date and base group by 1",
    "io10_sample": oracle("""with h as (select item_key, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split('7:' || item_key, ''), lambda d: ascii(d)::bigint)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)) as h from items)
      select item_key from h order by xor(h, 4294967295), item_key limit 200"""),
    "st1_changes": f"with {_E} select event_type, count(*) as n, max(ts) as mark from e where ts > {_HALF} group by 1",
    "st1_stream": f"select case when ts < {_HALF} then 0 else 1 end::bigint as batch, event_type, count(*) as n, max(ts) as mark from events group by 1, 2",
    "st2_invalidated": f"with {_E}, r as (select distinct user_id, 'bids' as result from e where k > 50 or event_type = 'purchase' union select distinct user_id, 'risk' from e where event_type = 'error' union select distinct user_id, 'page' from e) select result, count(*) as users from r group by 1",
    "st3_latest": f"with {_E} select user_id, max(event_id) as event_id, arg_max(ts, event_id) as ts, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from e group by 1",
    "st_hourly_counts": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "st4_snapshot": f"""with {_E}, o as (select event_id as listing, user_id as complex, ts from e where ts < {_HALF}), n as (select event_id as listing, user_id as complex from e where user_id % 2 = 0 and event_id % 3 <> 0), g as (select distinct complex from n)
      select coalesce(o.listing, n.listing) as listing, coalesce(o.complex, n.complex) as complex, coalesce(o.ts, timestamp '2024-02-01') as first_seen, case when n.listing is not null then timestamp '2024-02-01' else o.ts end as last_seen, n.listing is not null or g.complex is null as is_active
      from o full join n on o.listing = n.listing left join g on o.complex = g.complex""",
    "st5_purge": "select event_id % 3 as run, count(*) as n from events where event_id % 3 = 1 group by 1 union all select event_id % 3, -count(*) from events group by 1",
    "f8_open_work": "select distinct user_id from events where user_id not in (select user_id from events where event_type = 'purchase' and ts > timestamp '2024-01-24')",
    "st6_until_covered": "select distinct user_id, user_id % 12 <> 3 as found, case when user_id % 12 = 3 then 1 else user_id % 4 + 1 end::int as round from events where user_id % 10 <> 0",
    "st7_unsent": f"select distinct {_SITE} as site from pages where {_SITE} not in (select {_SITE} from pages where page_id % 2 = 0)",
    "st7_stream": f"select distinct {_SITE} as site from pages where {_SITE} not in (select {_SITE} from pages where page_id % 2 = 0)",
    "w9_ledger": f"with {_E}, a as (select event_id, user_id, (case when event_type = 'purchase' then -k else k % 7 end)::bigint as amount from e) select *, (sum(amount) over w)::bigint as balance, sum(amount) over w < 0 as overdrawn from a window w as (partition by user_id order by event_id)",
    "w10_membership": W10,
    "j19_members": "with p as (select user_id, count(*) as n from events where event_type = 'purchase' group by 1) select c_mktsegment as grade, count(*) as members, count(n) as payers, coalesce(sum(n), 0)::bigint as payments from customer left join p on c_custkey = user_id group by 1",
    "j15_points": oracle("""select 'auction' as source, item_key, lat, lng, case when status <> 'F' then min_price else 1 end as min_price, case when status = 'F' then 'old' when seq % 3 = 0 then 'good' end as grade from items where seq % 4 <> 1
      union all select 'public', p_partkey::varchar, null, null, case when p_size > 20 then p_size else 1 end::bigint, case when p_size > 20 then 'new' else 'old' end from part"""),
    "j16_zones": oracle("select item_key, lat, lng from items where seq % 12 = 0 and seq % 5 <> 0"),
    "j17_unsynced": oracle("select item_key, address from items where seq % 3 = 0 and seq % 2 = 1"),
    "w12_sections": """with l as (select l_orderkey as lot, l_linenumber % 4 as item, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as i, trim(rtrim(repeat('x ', (l_quantity % 7)::int)) || ' ' || l_partkey) as body from lineitem)
      select lot, item::int as "no", arg_max(body, (length(body), -i)) as body from l where item <> 0 and length(body) >= 2 group by lot, item""",
    "io1_typed": oracle("select lot::varchar as lot, id, result, sale_price, bid_count, null::bigint as sale_2nd_price, winner_name from schedule"),
    "io8_facets": "select r_name as name, count(*) as n, string_agg(n_name || ':' || n_nationkey, ',' order by n_name) as cities from nation join region on n_regionkey = r_regionkey group by r_name",
    "j22_specs": oracle("with v as (select floor(id / 1000)::bigint as seq, min(model_year) as model_year, max(mileage) as mileage from vehicles group by 1) select item_key, model_year, mileage from items left join v using (seq) where contains(usage_name, '승용차')"),
    "w6_first_occurrence": oracle("select sgg, umd, area, trade_id, amount from (select *, row_number() over (partition by sgg, umd, area order by trade_id, amount, deal_date) as n from trades) where n = 1"),
    "w6b_distinct_points": oracle("select lat, count(*) as n from (select distinct round_even(lat, 2) as lat, round_even(lng, 2) as lng from places) group by lat"),
    "w11_main_building": "select p_partkey % 300 as lot, arg_max(p_partkey, (p_size * 3 + p_partkey % 9 * 3 + p_partkey % 4 + case when p_type = 'STANDARD' then 100 else 0 end, -p_partkey)) as main from part group by 1",
    "f6_relevance": r"select doc_id, not regexp_matches(lower(text), 'scum|###') and not regexp_matches(lower(text), 'license|token\s*=') and regexp_matches(lower(text), 'the|der|que') as keep, regexp_matches(source, '(premium|blog|cafe)\.') or regexp_matches(text, '\(\s*\d[\d,]*\s*원\s*\)') or regexp_matches(text, '(?i)(광고|스폰서|sponsored)') as ad from documents",
    "x1_duplicate_titles": X1, "x1_kept_titles": X1_KEPT, "io10_split": oracle(IO10), "p30_sections": P30, "p30_detail": P30_DETAIL, "p31_waiver": P31,
    "t6_newest": "select event_type, place, event_id from (select *, row_number() over (partition by event_type order by ts desc, event_id) as place from events) where place <= 3",
    "t7_rounds": oracle("select lot, row_number() over (partition by lot order by case when id % 4 <> 3 then sell_day end nulls last, id) as place, id from schedule"),
    "io2_trades": "select l_orderkey as page, floor(l_extendedprice)::bigint * 10000 as amount, l_quantity as area, 't' || l_suppkey as umd, l_partkey::varchar as jibun, 'n' as name, case when l_linenumber <> 7 then l_shipdate::date end as deal_date from lineitem",
    "io3_summary": "select o_orderkey || '|' || o_custkey || '|' || o_orderkey % 4 as id, floor(o_totalprice)::bigint as min_price, floor(o_totalprice * 1.5)::bigint as appraisal_price, round_even(floor(o_totalprice) * 100.0 / floor(o_totalprice * 1.5), 0)::bigint as bid_ratio, (o_orderkey % 20)::int as floor, (o_orderkey % 900)::varchar as unit, case when o_orderkey % 6 <> 0 then o_orderdate end as bid_close from orders",
    "r7_multi_family": "with p as (select p_partkey as id, case when p_partkey % 5 <> 0 then p_retailprice * 0.6 end as area, p_size as units, p_partkey % 6 as floors from part), k as (select id, area <= 660 as ok_area, case when units > 0 then units <= 19 end as ok_units, case when floors between 1 and 3 then true end as ok_floors from p) select *, case when ok_area = false or ok_units = false then 'fail' when ok_area and ok_units and ok_floors then 'pass' else 'check' end as verdict from k",
    "r8_debt_demand": oracle("""with x as (select seq, appraisal_price as a, coalesce(est_price, 0) + case when seq % 2 = 0 then min_price else 0 end as t, seq % 25 as u, greatest(seq % 11, seq % 7) as o, tags from items), y as (select *, case when a > 0 and t > 0 then round_even(t / a * 100, 0)::bigint end as debt_ratio, case when u > 0 then least(100, round_even(o / u * 100, 0)::bigint) end as share from x)
      select seq, debt_ratio, case when debt_ratio is not null then t >= a end as debt_good, share, case when share >= 60 then 'good' when share >= 30 then 'mid' when share is not null then 'low' end as demand, regexp_matches(tags, '위반 ?건축물') as violation from y"""),
    "r11_brief": "select p_partkey as id, coalesce(case when p_partkey % 3 <> 0 and p_partkey * 9 between 1 and 9999 then p_partkey * 9 end, case when p_size between 1 and 9999 then p_size end) as units, coalesce(nullif(p_partkey % 4, 0), nullif(p_partkey % 9, 0)) as floors from part",
}
