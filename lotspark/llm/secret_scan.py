"""Secrets in texts, alone and by linking the parts of a credential.

A task finds spans: strong ones, which are reported as they are, and weak parts,
each an access identifier, a secret or an endpoint. Spark then interval-joins
the parts: a weak one is reported only if parts of both other roles, or for an
identifier a secret and for a secret an identifier, lie in its scope, ``SCOPE``
code points before or after it in the same text. Parts are binned by ``SCOPE``,
so a bin holds no more of them than fit, and a semi join emits no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text_arrays import small_batches, tidy

SCOPE = 400
_F = re.IGNORECASE | re.ASCII

#: Strong kinds, in the order in which equal starts are reported: pattern, group, least length.
STRONG = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _F), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
    "pem": (re.compile(r"-----BEGIN [A-Z ]*?PRIVATE KEY-----"), 0, 1),
    "github": (re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
    "jwt": (re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), 0, 32),
}
#: Substrings without which a strong pattern can't match; none for hex.
NEEDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "pem": ("-----BEGIN",), "github": ("gh",), "jwt": ("eyJ",), "hex": ()}

#: A name with what sets its value apart; each name is read once, whatever its length.
NAME = re.compile(r"""(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)["']?[\x20\t]*+(?:=>|:=|[:=])[\x20\t]*+["']?""", re.ASCII)
#: Weak parts that a name announces: role, words of the name, run of the value and its least length. Each is common in clean text and means something beside its complements only.
NAMED = {
    "id_part": ("identifier", ("user", "username", "login", "client_id", "account", "access_key_id"), re.compile(r"[A-Za-z0-9_.@-]++"), 3),
    "secret_part": ("secret", ("password", "passwd", "passphrase", "pass", "pwd", "secret", "token", "key", "auth", "credential", "credentials", "private"), re.compile(r"[A-Za-z0-9+/_.=!#$%&*@?^~-]++"), 6),
    "endpoint_part": ("endpoint", ("host", "hostname", "endpoint", "server", "region"), re.compile(r"[A-Za-z0-9_.:/-]++"), 3),
}
#: Weak parts by their form: role and pattern.
WEAK = {
    "blob_part": ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])")),
    "endpoint_part": ("endpoint", re.compile(r"(?<![A-Za-z0-9_])(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9_.:@/?&=%-]{4,}+", _F)),
}
#: User and password of an address are both parts of a credential.
USER_INFO = re.compile(r"://([A-Za-z0-9_.%+-]++):([^\s:/@\"'<>]++)@")
KINDS = [*STRONG, "id_part", "secret_part", "blob_part", "endpoint_part"]
#: Roles that strong spans take when they stand beside weak parts.
STRONG_ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "pem": "secret", "github": "secret", "jwt": "secret"}
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@lru_cache(50_000)
def named_kind(name: str) -> str | None:
    """The weak kind that a name announces, by the last keyword among its parts.

    Parts are joined by '_', '-' or camel case: DB_USER, access-key-id, dbPassFile.
    """
    for parts in (re.split("[_-]+", name), _CAMEL.findall(name)):
        joined = "_".join(parts).lower()
        at = {kind: max((m.end() for w in words for m in re.finditer(f"(?<![a-z0-9]){w}(?![a-z0-9])", joined)), default=0) for kind, (_, words, _, _) in NAMED.items()}
        if any(at.values()):
            return max(at, key=at.get)
    return None


def find_parts(text: str) -> list[tuple[str, str, bool, int, int]]:
    """(kind, role, strong, start, end) in code points, end exclusive; leftmost, non-overlapping per kind."""
    out = []
    low = text.lower()  # beyond ASCII this may only find more to look at
    longest = max(map(len, text.split()), default=0)
    for kind, (pattern, group, least) in STRONG.items():
        needs = NEEDS[kind]
        if longest < least and kind != "pem" or needs and not any(x in (low if kind == "assign" else text) for x in needs):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if b - a >= least:
                out.append((kind, STRONG_ROLE[kind], True, a, b))
    weak = []
    ends: dict[str, int] = {}
    if any(x.split("_")[0] in low for _, words, _, _ in NAMED.values() for x in words):
        for m in NAME.finditer(text):
            kind = (named_kind if len(m.group(1)) <= 200 else named_kind.__wrapped__)(m.group(1))  # long names aren't remembered
            if not kind:
                continue
            role, _, run, least = NAMED[kind]
            a = m.end()
            if a >= ends.get(kind, 0):  # else an earlier value's run, read once, goes on here
                value = run.match(text, a)
                ends[kind] = value.end() if value else a
            if ends[kind] - a >= least:
                weak.append((m.start(), kind, role, a, ends[kind]))
    for kind, (role, pattern) in WEAK.items():
        if longest >= 32 if kind == "blob_part" else "://" in text:
            weak += [(m.start(), kind, role, *m.span()) for m in pattern.finditer(text)]
    if "://" in text and "@" in text:
        for m in USER_INFO.finditer(text):
            weak += [(m.start(1), "id_part", "identifier", *m.span(1)), (m.start(2), "secret_part", "secret", *m.span(2))]
    last: dict[str, int] = {}
    told = {x[3] for x in out if x[1] == "secret"}  # a secret that is reported anyway is no weak part as well
    for begin, kind, role, a, b in sorted(weak):
        if begin >= last.get(kind, 0) and not (role == "secret" and a in told):
            out.append((kind, role, False, a, b))
            last[kind] = b
    return out


@tidy
def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for low in range(0, batch.num_rows, 1000):
            rows = []
            for i, text in enumerate(texts.slice(low, 1000).to_pylist(), low):
                rows.append((i, None, None, False, -1, -1))
                rows += [(i, *x) for x in find_parts(text or "")]
            at, kind, role, strong, start, end = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at)), pa.array(kind, pa.string()), pa.array(role, pa.string()), pa.array(strong), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                ["_id", "kind", "role", "strong", "start", "end"],
            )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per id of ``docs``: ``spans``, an array of (start, rank, kind, end), sorted.

    ``rank`` is the kind's place in ``KINDS``. Spans count code points, the end is
    exclusive. Null and empty texts have none; rows that repeat an id count as one
    document whose spans are united, each once; a weak part of a document without an
    id is never linked; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    # written once: three plans read what one scan of the texts has found
    found = scratch.save(rows.mapInArrow(_parts, f"_id {kind}, kind string, role string, strong boolean, start long, end long"))
    parts = found.where("kind is not null")
    weak = parts.where("not strong")

    def beside(left: DataFrame, roles: tuple[str, ...]) -> DataFrame:
        """Rows with a part of one of the roles in their scope."""
        bins = F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("bin")
        other = parts.where(F.col("role").isin(*roles)).select(F.col("_id").alias("id_b"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("bin_b"), F.col("start").alias("start_b"), F.col("end").alias("end_b"))
        near = F.expr(f"_id = id_b and bin = bin_b and start_b <= end + {scope} and end_b >= start - {scope} and (start_b >= end or end_b <= start)")
        return left.select("*", bins).join(other, near, "left_semi").drop("bin").distinct()

    linked = (
        beside(weak.where("role = 'identifier'"), ("secret",))
        .unionByName(beside(weak.where("role = 'secret'"), ("identifier",)))
        .unionByName(beside(beside(weak.where("role = 'endpoint'"), ("identifier",)), ("secret",)))
    )
    every = found.where("strong or kind is null").unionByName(linked)
    ranks = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", ranks[F.col("kind")].alias("rank"), "kind", "end"))
    return every.groupBy("_id").agg(F.array_sort(F.collect_set(span)).alias("spans")).select(F.col("_id").alias(id_col), "spans")
