"""Resolution of WARC revisit records (not modified) to earlier full responses.

An as-of join by canonical URL: a revisit gets the latest full response captured
before it, provided that their validators agree, and its headers with those a 304
may renew merged in. Captures of a URL are cut into runs of ``bucket`` seconds;
the latest response of each run is carried to later runs, so a URL with a large
share of all captures is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Headers that a not-modified response renews (RFC 9110, 15.4.5).
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
BUCKET = 3_600


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment, ``www.`` or session parameter; query sorted; no trailing slash; http for https."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.regexp_replace(F.lower(F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), "^https$", "http")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("(?i)^(sid|sessionid|phpsessid|jsessionid)="))
    return F.when(scheme == "", F.lower(plain)).otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per revisit: record_id, url, status, source_id, headers, payload_digest.

    ``records``: record_id, type (response or revisit), url, ts (timestamp), status
    (HTTP), headers (map, names in lower case), payload_digest. Only responses with
    status 200 count as full.

    status: ``resolved``; ``mismatch`` if the latest earlier response has another
    entity tag (weak comparison) or, without tags on both sides, another
    last-modified; ``unverified`` if the two share no kind of validator;
    ``missing`` without an earlier response, url or time. Only resolved rows have
    headers and a digest.

    Of captures at one time the one with the larger record_id is later (null is
    the smallest), of those with one record_id the one with the larger digest, then
    headers; a response at a revisit's very time isn't earlier. Null ids, headers
    and header values are allowed; a null value is no validator and renews nothing.
    Repeated revisits give repeated rows; other columns are ignored. The captures
    of one URL within ``bucket`` seconds are sorted in one task.
    """
    base = records.select(
        "record_id", F.col("type").alias("kind"), canonical_url(F.col("url")).alias("url"), "ts", F.col("status").alias("http"), F.map_entries("headers").alias("headers"), "payload_digest",
        F.floor(F.unix_timestamp("ts") / bucket).alias("run"),
    )
    full = base.where("kind = 'response' and http = 200 and url is not null and ts is not null")
    revisits = base.where("kind = 'revisit'")
    placed = "url is not null and ts is not null"
    # all that a revisit may need of a response goes with it: no join by record id
    response = F.struct("ts", "record_id", "payload_digest", F.array_sort("headers").alias("headers"))
    # the latest response of each run, carried to the runs after it
    runs = full.groupBy("url", "run").agg(F.max(response).alias("best"))
    asked = revisits.where(placed).groupBy("url", "run").agg(F.lit(True).alias("asked"))
    known = runs.join(asked, ["url", "run"], "full")
    before = F.last("best", True).over(W.partitionBy("url").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    carried = known.select("url", "run", "asked", before.alias("carried")).where("asked and carried is not null").drop("asked")
    # within a run: the latest response before each revisit; captures of one time: revisits first
    within = W.partitionBy("url", "run").orderBy("ts", F.when(F.col("kind") == "revisit", 0).otherwise(1), "record_id", "payload_digest", F.array_sort("headers"))
    latest = F.last(F.when(F.col("kind") == "response", response), True).over(within.rowsBetween(W.unboundedPreceding, -1))
    own = full.unionByName(revisits.where(placed)).withColumn("latest", latest).where("kind = 'revisit'")
    found = own.join(carried, ["url", "run"], "left").select("record_id", "url", "headers", F.coalesce("latest", "carried").alias("source"))
    lost = revisits.where(f"not ({placed})").select("record_id", "url", "headers", F.lit(None).cast(found.schema["source"].dataType).alias("source"))
    joined = found.unionByName(lost).select("record_id", "url", "source", *(F.map_filter(F.coalesce(F.map_from_entries(c), F.expr("cast(map() as map<string,string>)")), lambda k, v: v.isNotNull()).alias(name) for c, name in (("headers", "new"), ("source.headers", "old"))))
    tag, old_tag, since, old_since = _weak(F.col("new")["etag"]), _weak(F.col("old")["etag"]), F.col("new")["last-modified"], F.col("old")["last-modified"]
    status = (
        F.when(F.col("source").isNull(), "missing")
        .when(tag.isNotNull() & old_tag.isNotNull(), F.when(tag == old_tag, "resolved").otherwise("mismatch"))
        .when(since.isNotNull() & old_since.isNotNull(), F.when(since == old_since, "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    renew = F.map_filter("new", lambda k, v: k.isin(*RENEWED))
    kept = F.map_filter("old", lambda k, v: ~F.array_contains(F.map_keys(renew), k))
    ok = F.col("status") == "resolved"
    return joined.withColumn("status", status).select(
        "record_id", "url", "status", F.col("source.record_id").alias("source_id"),
        F.when(ok, F.map_concat(kept, renew)).alias("headers"), F.when(ok, F.col("source.payload_digest")).alias("payload_digest"),
    )
