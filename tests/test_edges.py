"""Small cases of what only larger tables showed: edges of cells, groups that every row of a kind shares, repeated keys."""

import duckdb

from lotspark.plans import registry

from .compare import both

QUERIES, ORACLES = registry.queries(), registry.oracles()


def same_as_sql(spark, folder, name, **tables):
    """The query's rows over the given tables (by SQL), which have to be those of its SQL."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = both(con, QUERIES[name](spark, str(folder)), ORACLES[name])
    assert got == want
    return got


def test_path_points_at_the_edge_of_two_cells(spark, tmp_path):
    customer = "select unnest([31016, 17396, 33776, 4307])::bigint as c_custkey, 'BUILDING' as c_mktsegment"
    supplier = "select unnest([2067, 1159, 2251, 287])::bigint as s_suppkey"
    assert same_as_sql(spark, tmp_path, "a18_flow_grid", customer=customer, supplier=supplier)


#: A town of one complex: by number, by name, by both names of an address, by none; days before and after the lots' own.
PART = "select i::bigint as p_partkey, ['red ring', 'hot red ring', 'blue bolt'][i % 3 + 1] as p_name, 'Brand#1' as p_brand, 'LARGE' as p_type, 5 as p_size, 900.0::double as p_retailprice from range(0, 600, 50) r(i)"
ORDERS = "select i::bigint as o_orderkey, (i * 50 % 600)::bigint as o_custkey, 1000.0::double as o_totalprice, timestamp '1996-01-01' + interval (i) day as o_orderdate from range(60) r(i)"
LINES = """select (i % 40)::bigint as l_orderkey, (i * 50 % 300)::bigint as l_partkey, i % 7 as l_suppkey, (i % 3)::int as l_linenumber, (8 + i % 36)::double as l_quantity, (1000 + i % 11)::double as l_extendedprice,
  timestamp '1995-10-01' + interval (i % 150) day as l_shipdate from range(6000) r(i)"""


def test_complexes_are_added_up_before_lots_meet_them(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, "a11_chips", part=PART, orders=ORDERS, lineitem=LINES)
    assert max(r[1] for r in rows) == 100
    con_rows = same_as_sql(spark, tmp_path, "j7_same_complex", part=PART, orders=ORDERS, lineitem=LINES)
    assert len(con_rows) == 60
    for name in ("a11_chips", "j7_same_complex"):
        assert joined_rows(QUERIES[name](spark, str(tmp_path))) <= 6000


#: Vehicles of two fuels, one maker and year and two mileages, half of them for sale; ids and prices repeat.
CARS = """select (i % 1900)::bigint as l_orderkey, (i % 2 * 50)::bigint as l_partkey, i % 7 as l_suppkey, (i % 3)::int as l_linenumber, (8 + i // 2 % 2)::double as l_quantity, (1000 + i % 170)::double as l_extendedprice,
  if(i % 3 = 0, 'O', 'F') as l_linestatus, timestamp '1999-10-01' + interval (i % 150) day as l_shipdate from range(4000) r(i)"""


def test_prices_of_alike_vehicles_are_counted_once(spark, tmp_path):
    assert len(same_as_sql(spark, tmp_path, "j6_vehicles", part=PART, lineitem=CARS)) > 100
    assert joined_rows(QUERIES["j6_vehicles"](spark, str(tmp_path))) <= 4000


def test_alike_vehicles_meet_the_ads_once(spark, tmp_path):
    for name in ("j11_ads", "f7_generic"):
        assert len(same_as_sql(spark, tmp_path, name, part=PART, lineitem=CARS)) > 100
        assert joined_rows(QUERIES[name](spark, str(tmp_path))) < 50_000


def joined_rows(df) -> int:
    """Rows that the joins of a query put out, at most, as counted while it runs."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            plan.append(node.plan())
        found = node.metrics().get("numOutputRows")
        if "Join" in node.nodeName() and found.isDefined():
            most = max(most, found.get().value())
        kids = node.children()
        plan += [kids.apply(i) for i in range(kids.size())]
    return most


def test_radius_meets_at_the_edges_of_places(spark):
    """All pairs of lots around the edges of squares, prices and floors; past them none."""
    import datetime as dt
    import math
    import random

    from pyspark.sql import functions as F

    from lotspark.operators import comparables

    draw = random.Random(3)
    rows = [(i, 37 + draw.random() / 25 - (74 if i % 2 else 0) * (i % 3 == 0), draw.random() / 25, 50.0 + draw.randint(0, 9), draw.choice([0, 15, 30, 31, 45]) * 1_000_000, draw.randint(-1, 5), dt.date(2000, 1, 1) + dt.timedelta(draw.randint(0, 1500))) for i in range(700)]
    rad = math.radians
    metres = lambda a, b: 2 * 6371000 * math.asin(math.sqrt(math.sin(rad(b[1] - a[1]) / 2) ** 2 + math.cos(rad(a[1])) * math.cos(rad(b[1])) * math.sin(rad(b[2] - a[2]) / 2) ** 2))
    back = lambda d: d.replace(year=d.year - 3, day=min(d.day, 28) if d.month == 2 else d.day)
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and metres(a, b) <= 1000 and abs(a[3] - b[3]) <= 6 and abs(a[4] - b[4]) <= 15_000_000 and abs(a[5] - b[5]) <= 1 and back(a[6]) <= b[6] <= a[6])
    lots = spark.createDataFrame(rows, "key long, lat double, lng double, area double, appraisal long, floor int, day date").withColumn("rate", F.lit(70.0)).withColumn("sale_price", F.lit(5))
    hashes = {r.h: r.key for r in lots.select("key", F.xxhash64("key").alias("h")).collect()}
    assert sorted((hashes[r.target], hashes[r.case]) for r in comparables.within_radius(lots, lots).collect()) == want and want


def test_price_curve_deals_a_lots_rows_once(spark):
    from .compare import SF

    df = QUERIES["price_curve"](spark, SF)
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            plan.append(node.plan())
        found = node.metrics().get("shuffleRecordsWritten")
        most = max(most, found.get().value() if found.isDefined() else 0)
        kids = node.children()
        plan += [kids.apply(i) for i in range(kids.size())]
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count() * 2 + spark.read.parquet(f"{SF}/orders.parquet").count()
    assert 0 < most <= rows
