"""Lot search: filters, named sorts with paging, status counts, facets, favourites."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalar import PROVINCES, address_parts, reconciled_result
from .ranking import with_places

#: Status groups, statuses in the order of their first match, sorts.
STATUS_GROUPS = {
    "진행물건": ["신건", "유찰", "재진행", "재매각"],
    "종결물건": ["매각", "배당종결", "잔금납부", "취하", "기각", "정지", "미진행", "대금미납", "변경", "불허"],
    "매각/잔금납부/배당종결": ["매각", "잔금납부", "배당종결"],
}
STATUSES = ["신건", "유찰", "매각", "재진행", "재매각", "변경", "취하", "정지", "미진행", "배당종결", "기각", "잔금납부", "각하"]
SORTS = {
    "case": ("case_sort", True), "sell_day": ("sell_day", True), "appraisal_high": ("appraisal_price", False), "appraisal_low": ("appraisal_price", True),
    "minimum_high": ("min_price", False), "minimum_low": ("min_price", True), "failed_most": ("fail_count", False), "similar_most": ("similar_count", False),
    "built_new": ("build_year", False), "built_old": ("build_year", True), "households_most": ("households", False), "households_least": ("households", True),
    "mileage_low": ("mileage", True), "mileage_high": ("mileage", False), "profit_high": ("profit", False),
}


@dataclass
class Search:
    """What to look for; every field is optional.

    ``equal``: column -> value or list of values (group, usages, grade, regulation,
    fuel, brand, zone, court...). ``at_least`` and ``at_most``: column -> bound.
    ``known``: columns that may not be null. ``true``: flags that have to hold.
    """

    data_class: str | None = "현황"
    equal: dict[str, object] = field(default_factory=dict)
    at_least: dict[str, object] = field(default_factory=dict)
    at_most: dict[str, object] = field(default_factory=dict)
    known: list[str] = field(default_factory=list)
    true: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    keyword: str | None = None
    region: str | None = None
    regions: list[str] = field(default_factory=list)
    province: str | None = None
    year: str | None = None
    case_no: str | None = None
    status: str | None = None
    sell_from: str | None = None
    sell_to: str | None = None

    def predicate(self) -> Column:
        """All conditions as one column; simple ones reach the scan."""
        status, day_from, day_to = self.status, self.sell_from, self.sell_to
        if self.case_no:  # a case is found whatever its status and day
            status = day_from = day_to = None
        past = set(STATUS_GROUPS) - {"진행물건"} | set(STATUS_GROUPS["종결물건"])
        wide = self.data_class == "현황" and bool(status in past or day_from or day_to or self.case_no)
        tests: list[Column] = []
        if self.data_class and not wide:
            tests.append(F.col("data_class") == self.data_class)
        for c, v in self.equal.items():
            tests.append(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
        tests += [F.col(c) >= v for c, v in self.at_least.items()] + [F.col(c) <= v for c, v in self.at_most.items()]
        tests += [F.col(c).isNotNull() for c in self.known] + [F.col(c) for c in self.true]
        has = lambda c, word: F.contains(F.lower(F.col(c)), F.lit(word.lower()))
        for tag in filter(None, map(str.strip, self.tags)):
            if "제외" in tag:
                base = re.sub(r"\s*제외.*$", "", tag)
                tests += [~has("tags", base)] if base else []
            else:
                tests.append(has("tags", tag))
        words = lambda text: reduce(lambda a, b: a & b, [has("address", w) for w in text.split()])
        if self.keyword:
            tests.append(has("address", self.keyword))
        if self.region and self.region.split():
            tests.append(words(self.region))
        some = [words(r) for r in self.regions if r.split()]
        if some:
            tests.append(reduce(lambda a, b: a | b, some))
        if self.province:
            tests.append(reduce(lambda a, b: a | b, [F.col("address").startswith(v) for v in [self.province, *PROVINCES.get(self.province, [])]]))
        if self.case_no:
            whole = re.match(r"^\s*(\d{4})\s*(?:타경|-)\s*(\d+)\s*$", self.case_no)
            digits = re.sub(r"\D", "", self.case_no)
            if whole or self.year:
                tests.append(F.col("case_no") == (f"{whole[1]}-{whole[2]}" if whole else f"{self.year}-{digits}"))
            elif digits:
                tests.append(F.col("case_no").endswith(f"-{digits}"))
        elif self.year:
            tests.append(F.col("case_no").startswith(f"{self.year}-"))
        if status:
            tests.append(reduce(lambda a, b: a | b, [F.col("result").startswith(s) for s in STATUS_GROUPS.get(status, [status])]))
        if day_from:
            tests.append(F.col("sell_day") >= F.lit(day_from).cast("date"))
        if day_to:
            tests.append(F.col("sell_day") <= F.lit(day_to).cast("date"))
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def search(lots: DataFrame, what: Search) -> DataFrame:
    return lots.where(what.predicate())


def page(lots: DataFrame, sort: str = "sell_day", then: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page in a named order, unknown values last; item_key settles ties."""
    order = []
    for name in [n for n in (sort, then) if n]:
        c, up = SORTS.get(name, SORTS["sell_day"])
        order.append(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last())
    return lots.orderBy(*order, "item_key").offset(offset).limit(limit)


def status_counts(lots: DataFrame, by: str) -> DataFrame:
    """Counts by status, by kind and in all, in one pass of grouping sets: level, status, kind, n."""
    r = F.trim(reconciled_result(F.col("result"), F.col("data_class"), F.col("status_reason")))
    status = reduce(lambda c, s: c.when(r.startswith(s), s), STATUSES[1:], F.when(r.startswith(STATUSES[0]), STATUSES[0]))
    d = lots.select(F.coalesce(status, F.lit("?")).alias("status"), F.col(by).alias("kind"))
    g = d.groupingSets([["status"], ["kind"], []], "status", "kind").agg(F.count("*").alias("n"), F.grouping("status").alias("gs"), F.grouping("kind").alias("gk"))
    level = F.when(F.col("gs") == 0, "status").when(F.col("gk") == 0, "kind").otherwise("total")
    return g.select(level.alias("level"), F.when(F.col("gs") == 0, F.col("status")).alias("status"), F.when(F.col("gk") == 0, F.col("kind")).alias("kind"), "n")


def region_tree(lots: DataFrame) -> DataFrame:
    """province, district, town, n: lot counts of every level of the region tree."""
    p = lots.select(address_parts(F.col("address")).alias("p")).where("p.province is not null").select("p.*")
    r = p.rollup("province", "district", "town").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return r.where("g < 7").select("province", "district", "town", "n", F.col("g").cast("int").alias("g"))


def facets(lots: DataFrame, *columns: str, save) -> DataFrame:
    """facet, value, n, place: the values of each column by falling frequency; ``save`` writes and rereads a table."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("f")
    n = lots.select(pairs).select("f.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))
    return with_places(n, ["facet"], [F.col("n").desc(), F.col("value").asc()], save)


def in_stated_order(lots: DataFrame, keys: list[str]) -> DataFrame:
    """The lots of ``keys`` in their order, with ``pos``; a key that isn't there leaves no row."""
    spark = lots.sparkSession
    wanted = spark.createDataFrame([(keys,)], "keys array<string>").select(F.posexplode("keys").alias("pos", "item_key"))
    return lots.join(wanted, "item_key").orderBy("pos")


def top_by(df: DataFrame, group: str, value: str, n: int, tie: str) -> DataFrame:
    """The n rows of each group with the largest value; unknown ones are left out."""
    order = W.partitionBy(group).orderBy(F.col(value).desc(), tie)
    return df.where(F.col(value).isNotNull()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def sale_days_around(lots: DataFrame, as_of: Column) -> DataFrame:
    """Next sale day of live lots after ``as_of`` and last day of sold ones before it."""
    return lots.agg(
        F.min(F.when((F.col("sell_day") > as_of) & (F.col("data_class") == "현황"), F.col("sell_day"))).alias("next_day"),
        F.max(F.when((F.col("sell_day") < as_of) & F.col("result").startswith("매각"), F.col("sell_day"))).alias("last_day"),
    )
