"""Reading and writing tables with fixed schemas, landed texts and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import found
from .versions import replace

SCHEMAS = {
    "items": "item_key string, case_no string, court_code string, usage_name string, search_group string, address string, area_text string, building_area string, appraisal_price bigint, min_price bigint, sale_price bigint, sale_rate string, sell_date string, result string, status_reason string, data_class string, tags string, fail_count int, bid_count int, sale_2nd_price bigint, est_price bigint, lat double, lng double, changed_fields array<string>, updated_at timestamp",
    "rights": "lot string, seq int, kind string, reg_date date, holder string, amount bigint, note string, whole boolean, demanded boolean",
    "tenants": "lot string, seq int, name string, move_in date, fixed date, deposit bigint, rent bigint, demanded boolean, demand_date date, occupying boolean",
    "schedule": "lot string, id bigint, result string, sale_price bigint, bid_count int, sale_2nd_price bigint, winner_name string",
    "trades": "sgg string, umd string, jibun string, name string, area double, floor string, build_year string, amount bigint, deal_date date",
    "complexes": "complex_no string, name string, address string, households int",
    "listings": "listing_id bigint, complex_no string, item_key string, trade_type string, price bigint, area_excl double, is_active boolean",
    "vehicles": "item_key string, maker string, model string, model_year int, mileage bigint, fuel string, displacement int, accidents_self int, accidents_other int, damage bigint, note string",
}


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A table by its stated schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def key_ranges(spark: SparkSession, url: str, name: str, key: str, parts: int, **options) -> list[str]:
    """Predicates that split a database table into ``parts`` ranges of about as many rows each; rows without a key go with the first.

    The database counts the keys by steps between its least and largest one, and the
    steps that hold too many once more by smaller ones, so keys that lie unevenly
    still make even ranges; only those counts come back.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    low, high, total = reader.option("query", f"select min({key}) as low, max({key}) as high, count({key}) as n from {name}").load().first()
    if not total or low == high or parts < 2:
        return ["1 = 1"]

    def counted(low: int, high: int) -> list[tuple[int, int, int]]:
        """(first key, key after the last, rows) of the steps that have any."""
        step = -(-(high - low) // (parts * 16))
        slots = reader.option("query", f"select slot, count(*) as n from (select ({key} - {low}) / {step} as slot from {name} where {key} >= {low} and {key} < {high}) t group by slot").load()
        return [(low + int(s) * step, min(high, low + (int(s) + 1) * step), n) for s, n in slots.collect()]

    todo, steps = [(int(low), int(high) + 1, total)], []
    while todo:
        low, high, n = todo.pop()
        if n * parts * 4 > total and high - low > 1:
            todo += counted(low, high)
        else:
            steps.append((low, high, n))
    edges, seen = [], 0
    for _, after, n in sorted(steps):
        seen += n
        if seen * parts >= total * (len(edges) + 1) and len(edges) < parts - 1:
            edges.append(after)
    middle = [f"{key} >= {a} and {key} < {b}" for a, b in zip(edges, edges[1:], strict=False)]
    return [f"{key} < {edges[0]} or {key} is null", *middle, f"{key} >= {edges[-1]}"]


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, parts: int, **options) -> DataFrame:
    """A database table in up to ``parts`` ranges of a whole-number key, one query each; ``key`` is written as SQL wants it, with quotes if need be."""
    return spark.read.jdbc(url, name, predicates=key_ranges(spark, url, name, key, parts, **options), properties={k: str(v) for k, v in options.items()})


TRADE_XML = "item array<struct<dealAmount:string,dealYear:string,dealMonth:string,dealDay:string,excluUseAr:string,umdNm:string,jibun:string,aptNm:string>>"


def parse_trades(pages: DataFrame, xml: str = "body") -> DataFrame:
    """Trades out of landed XML pages: amounts in 10,000 won become won, three date parts one day; bad days are null."""
    e = pages.select("*", F.explode(F.from_xml(F.col(xml), TRADE_XML)["item"]).alias("i"))
    part = lambda c, n: F.lpad(F.trim(c), n, "0")
    day = F.try_to_date(F.concat_ws("-", part(F.col("i.dealYear"), 4), part(F.col("i.dealMonth"), 2), part(F.col("i.dealDay"), 2)), "yyyy-MM-dd")
    return e.select(*(c for c in pages.columns if c != xml), F.nullif(F.regexp_replace("i.dealAmount", "[^0-9]", ""), F.lit("")).cast("bigint").__mul__(10_000).alias("amount"), F.col("i.excluUseAr").try_cast("double").alias("area"), F.trim("i.umdNm").alias("umd"), F.trim("i.jibun").alias("jibun"), F.trim("i.aptNm").alias("name"), day.alias("deal_date"))


def sale_summary(rows: DataFrame) -> DataFrame:
    """Typed summary of a public-sale list row: id triple, ratio, floor and unit from the name, closing time."""
    number = lambda c: F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).cast("bigint")
    low, high = number(F.col("minimum")), number(F.col("appraisal"))
    return rows.select(
        F.concat_ws("|", "cltrno", "pbctno", "round").alias("id"), low.alias("min_price"), high.alias("appraisal_price"), F.when(high > 0, F.bround(low * 100.0 / high, 0).cast("long")).alias("bid_ratio"),
        found(F.col("name"), r"(\d+)\s*층").cast("int").alias("floor"), found(F.col("name"), r"(\d+)\s*호").alias("unit"), F.try_to_timestamp("closes", F.lit("yyyyMMddHHmm")).alias("bid_close"),
    )


def field(json: Column, path: str) -> Column:
    """One value of a JSON text column."""
    return F.get_json_object(json, f"$.{path}")


def lookup(rows: DataFrame, cache: DataFrame, key: str, prefix: str) -> DataFrame:
    """Cached values of many keys: one left join instead of chunked reads."""
    c = cache.where(F.col("cache_key").startswith(prefix)).select(F.expr(f"substring(cache_key, {len(prefix) + 1})").alias(key), F.col("data").alias("cached"))
    return rows.join(c, key, "left")


def write_facets(df: DataFrame, path: str) -> None:
    """Nested rows as JSON files that replace the older ones at once; ``versions.read`` reads them."""
    replace(df, path, "json")
