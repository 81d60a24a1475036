"""Registered queries of the training-data operators, and SQL for those that SQL can express.

Each query is thin: it reads its table, applies the operator and derives the
columns that are compared.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, langid, licenses, lm, media, neardup, phrases, pii, repair, secret_scan, warc

#: Stands for the key that a caller keeps secret.
PII_KEY = "replace-me"
VOCABULARY = "byte_bpe_50k.tiktoken"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.with_pseudonyms(docs, PII_KEY)
    counts = [F.expr(f"cast(size(filter(pii, m -> m.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, "text")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a vector is small, what is made of it isn't: drawing and describing are dealt over all tasks
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition("vec_id")
    return media.image_copies(media.draw_vectors(vectors))


#: Fetches of each page.
FETCHES = 4


def page_captures(pages: DataFrame) -> DataFrame:
    """Capture records of ``pages``: each page is fetched ``FETCHES`` times, a day apart, a minute after the page before it by id.

    Half of the fetches are full responses. The others are not-modified revisits with
    the entity tag that most of the URL's responses have.
    """
    fetched = pages.withColumn("fetch", F.explode(F.sequence(F.lit(0), F.lit(FETCHES - 1)))).withColumn("id", F.col("page_id") * FETCHES + F.col("fetch"))
    h = F.expr("pmod(crc32(cast(id as string)), 8)")
    url = warc.canonical_url(F.col("url"))
    tag = F.concat(F.lit('"'), F.substring(F.md5(url), 1, 12), F.when(h == 7, F.lit("-new")).otherwise(F.lit("")), F.lit('"'))
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + F.col("fetch") * 86_400)
    revisit = h < 4
    headers = F.map_from_entries(F.array(
        F.struct(F.lit("etag"), tag), F.struct(F.lit("date"), F.col("id").cast("string")),
        F.struct(F.when(revisit, F.lit("cache-control")).otherwise(F.lit("content-type")), F.when(revisit, F.lit("max-age=60")).otherwise(F.lit("text/html"))),
    ))
    return fetched.select(
        F.col("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("type"), "url", ts.alias("ts"),
        F.when(revisit, 304).otherwise(200).alias("status"), headers.alias("headers"), F.when(~revisit, F.md5("html")).alias("payload_digest"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(page_captures(read(spark, sf_dir, "pages")))
    joined = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "url", "status", "source_id", joined.alias("headers"), "payload_digest")


#: DuckDB; the host's case, fragments and the rest as in canonical_url.
SQL4 = r"""
with u as (
  select page_id, url, html, regexp_replace(trim(url), '#.*$', '') as p from pages
), s as (
  select *, regexp_replace(lower(regexp_extract(p, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), '^https$', 'http') as scheme,
    regexp_replace(regexp_replace(lower(regexp_extract(p, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') as host,
    regexp_replace(regexp_extract(p, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(p, '\?(.*)$', 1), '&'), lambda q: q <> '' and not regexp_matches(q, '^(?i)(sid|sessionid|phpsessid|jsessionid)='))) as q
  from u
), c as (
  select page_id, html, case when scheme = '' then lower(p) else scheme || '://' || host || path || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end end as curl
  from s
), fetched as (
  select page_id * 4 + f as id, 1700000000 + page_id * 60 + f * 86400 as ts, curl, html from c, unnest(range(4)) as r(f)
), hashed as (
  -- crc32 of the id's digits, bit by bit
  select *, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(id::varchar, ''), lambda d: ascii(d)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)) as crc
  from fetched
), r as (
  select id, ts, curl, html, xor(crc, 4294967295) % 8 as h from hashed
), t as (
  select id, ts, curl, h, '"' || substr(md5(curl), 1, 12) || case when h = 7 then '-new' else '' end || '"' as tag, md5(html) as digest from r
), rev as (select * from t where h < 4), resp as (select * exclude (ts), ts as at from (select *, row_number() over (partition by curl, ts order by id desc) as last from t where h >= 4) where last = 1)
select v.id as record_id, v.curl as url,
  case when p.id is null then 'missing' when p.tag = v.tag then 'resolved' else 'mismatch' end as status,
  p.id as source_id,
  case when p.tag = v.tag then 'cache-control=max-age=60;content-type=text/html;date=' || v.id || ';etag=' || v.tag end as headers,
  case when p.tag = v.tag then p.digest end as payload_digest
from rev v asof left join resp p on v.curl = p.curl and v.ts > p.at
"""


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_examples(turns.unionByName(own)))


SQL5 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), n as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as n, count(*) filter (role = 'assistant') over (partition by conv_id) as answers,
    count(*) filter (role = 'assistant') over (w rows between unbounded preceding and 1 preceding) as before,
    12 + 11 + length(role) + 1 + length(text)
      + length(role) - length(replace(replace(role, '\', ''), chr(10), '')) + length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(role || '|' || text, '<\||</?s>|</?SYS>>|\[/?INST\]')) as chars
  from t window w as (partition by conv_id order by turn, role, text)
), e as (
  select *, answers - before + case when (max(case when role = 'assistant' then i end) over (partition by conv_id)) is distinct from n then 1 else 0 end as examples from n
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars * examples)::bigint as formatted_chars
from e group by conv_id
"""


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).drop("text")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.expr("pmod(crc32(cast(doc_id as string)), 3) = 1"))
    model = langid.train_prototypes(docs.where("not held_out"))
    return langid.identify_language(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


SQL9 = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bwin as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as gram
  from bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as r(i) where len(w) > 0
), sizes as (select distinct n from bwin), dwin as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as gram from dw, sizes, unnest(range(1, len(w) - n + 2)) as r(i) where len(w) >= n
), hits as (select distinct doc_id, i, d.n, item_id from dwin d join bwin b on d.gram = b.gram and d.n = b.n),
places as (select doc_id, count(distinct p) as n_hit from hits, unnest(range(i, i + n)) as r(p) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as items from hits group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join places using (doc_id) left join items using (doc_id)
"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ids may repeat or lack, and each row's text has its own result; a number that may be null, as the tasks' schema says
    row = F.expr("nullif(monotonically_increasing_id(), -1)").alias("row")
    docs = read(spark, sf_dir, "documents").select(F.struct(row, "doc_id").alias("doc"), "text")
    found = secret_scan.scan_secrets(docs, "doc")
    named = "transform({}, s -> concat(s.kind, ':', s.start, ':', s.end))"
    base = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    own = named.format("filter(spans, s -> s.kind in ('assign', 'access', 'hex'))")
    return found.select("doc.doc_id", *base, F.expr(f"sha2(array_join({own}, ','), 256)").alias("base_sha256"), F.expr(f"array_join({named.format('spans')}, ',')").alias("spans"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.expr("pmod(crc32(cast(doc_id as string)), 7) <> 2").alias("learn"))
    return lm.score_texts(docs, "learn").select("doc_id", F.expr("not learnt").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given the role user, by a hash of their id."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    h = F.pmod(F.crc32(key), F.lit(20))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), h.alias("h"),
    )
    return rows.where("h > 0").withColumn("again", F.explode(F.expr("if(h = 3, array(0, 1), array(0))"))).drop("h", "again")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_conversations(damaged(turns), conversations=turns.select("conv_id"))


#: Forward only: each conversation's four states carry cost, audit and repaired lines from row to row.
SQL12 = r"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
), h as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda d: ascii(d)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295) % 20 as h
  from k
), d as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from h, unnest(case when h = 3 then [0, 1] else [0] end) as r(again) where h > 0
), o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d
), f as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '.' end as fault,
    left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) as pair
  from o
), c as (
  select conv_id, list({'r': role, 't': text, 'f': fault} order by i) as rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal
  from f group by conv_id
), s(conv_id, i, n, s, u, a) as (
  select conv_id, 0, {'c': 0, 'a': '', 'l': []::varchar[]}, {'c': 1000000, 'a': '', 'l': []::varchar[]}, {'c': 1000000, 'a': '', 'l': []::varchar[]}, {'c': 1000000, 'a': '', 'l': []::varchar[]} from c
  union all
  select conv_id, i + 1,
    {'c': n.c + 4, 'a': n.a || 'D', 'l': n.l},
    list_min([{'c': s.c + 4, 'a': s.a || 'D', 'l': s.l}, {'c': n.c + bad + case when left(e.r, 1) = 's' then 0 else 1000000 end, 'a': n.a || 'K', 'l': list_append(n.l, e.r || ':' || e.t)}]),
    list_min([{'c': pu.c + 4, 'a': pu.a || 'D', 'l': pu.l}] || list_concat(
      list_transform([n, s, pa], lambda p: {'c': p.c + bad + case when left(e.r, 1) = 'u' then 0 else 1000000 end, 'a': p.a || 'K', 'l': list_append(p.l, e.r || ':' || e.t)}),
      list_transform([n, s, pa], lambda p: {'c': p.c + bad + 3, 'a': p.a || 'R', 'l': list_append(p.l, 'user:' || e.t)}))),
    list_min([{'c': pa.c + 4, 'a': pa.a || 'D', 'l': pa.l}, {'c': pu.c + bad + case when left(e.r, 1) = 'a' then 0 else 1000000 end, 'a': pu.a || 'K', 'l': list_append(pu.l, e.r || ':' || e.t)},
      {'c': pu.c + bad + 3, 'a': pu.a || 'R', 'l': list_append(pu.l, 'assistant:' || e.t)}])
  from (
    select *, case e.f when '.' then 0 when 't' then 3 else 1000000 end as bad,
      list_min([u] || list_transform([n, s, a], lambda p: {'c': p.c + 3, 'a': p.a || 'I', 'l': list_append(p.l, 'user:')})) as pu,
      list_min([a, {'c': u.c + 3, 'a': u.a || 'I', 'l': list_append(u.l, 'assistant:')}] || list_transform([n, s], lambda p: {'c': p.c + 6, 'a': p.a || 'II', 'l': list_concat(p.l, ['user:', 'assistant:'])})) as pa
    from (select s.*, rows[s.i + 1] as e from s join c on s.conv_id is not distinct from c.conv_id where s.i < len(rows))
  )
), z as (
  select s.conv_id, list_min([n, a, {'c': u.c + 3, 'a': u.a || 'I', 'l': list_append(u.l, 'assistant:')}, {'c': s.s.c + 6, 'a': s.s.a || 'II', 'l': list_concat(s.s.l, ['user:', 'assistant:'])}]) as best
  from s join c on s.conv_id is not distinct from c.conv_id where s.i = len(rows)
)
select k.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) k left join c on k.conv_id is not distinct from c.conv_id left join z on k.conv_id is not distinct from z.conv_id
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


SQL13 = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
totals as (select lang, sum(len(w)) as n from w group by lang),
f as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as f
  from w, unnest(range(1, 6)) as s(k), unnest(range(1, len(w) - k + 2)) as r(i) where len(w) >= k group by all having count(*) >= 100
), s as (select *, string_split(phrase, ' ') as w from f),
inside as (select lang, phrase, max(f) as more from (select lang, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 : k], ' ')]) as phrase, f from s where k >= 3) group by all),
cuts as (
  select s.lang, s.phrase, s.f as a, l.f as l, r.f as r, n, c, (1000 * s.f::hugeint * n::hugeint) // (l.f::hugeint * r.f::hugeint) as score
  from s join totals on s.lang = totals.lang left join inside i on i.lang = s.lang and i.phrase = s.phrase, unnest(range(1, s.k)) as x(c)
  join f l on l.lang = s.lang and l.phrase = array_to_string(s.w[1 : c], ' ') join f r on r.lang = s.lang and r.phrase = array_to_string(s.w[c + 1 : s.k], ' ')
  where s.k >= 2 and (more is null or 100 * more < 100 * s.f)
), best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, c) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from best qualify rank <= 2000
"""


QUERIES = {f.__name__: f for f in (op1_pii, op2_licenses, op3_media, op4_warc, op5_chat, op6_neardup, op7_bpe, op8_language, op9_decontamination, op10_secrets, op11_language_model, op12_repair, op13_collocations)}
ORACLES = {"op4_warc": SQL4, "op5_chat": SQL5, "op9_decontamination": SQL9, "op12_repair": SQL12, "op13_collocations": SQL13}
