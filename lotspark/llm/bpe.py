"""Byte-level BPE with a given vocabulary, run by DuckDB inside Spark's tasks.

Spark deals the texts. A task cuts them into pre-tokens and hands each distinct
one to a recursive query: each round contracts a word's leftmost pair of least
rank and joins its new pairs with the table of those that make a token, and words
without a pair leave, until none is left. Rank and merged token are one number
here, as in every vocabulary of this kind. Ordered aggregation turns tokens back
into bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator
from itertools import batched

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import small_batches, tidy

#: Distinct pre-tokens, and bytes of them, that a task remembers; beyond either the memory starts anew.
CACHE, CACHE_BYTES = 400_000, 16_000_000
#: Bytes of a pre-token beyond which a heap finds its merges instead of the query.
LONG = 400
#: Characters of text whose pre-tokens are collected before the next query.
BLOCK = 2_000_000
#: Tokens in the rows of all rounds that one query may make at most: a pre-token of n bytes makes n (n + 1) / 2 at most.
ROWS = 2_000_000
#: Tokens that one query decodes.
TOKENS = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens of a vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: Rank of two tokens that make none.
NONE = 2**31 - 1
#: A word's row holds its tokens and, at each token's place, the rank of its pair with the next one; the place of the
#: first least rank is the head. Only the pairs before and behind the merged token are looked up again.
ENCODE = f"""
with recursive step(word, ids, ranks, low) as (
  select word, ids, ranks, list_min(ranks) from start
  union all
  select word, ids, ranks, list_min(ranks) from (
    select n.word, n.ids,
           list_concat(case when n.head > 1 then list_append(n.ranks[1:greatest(n.head - 2, 0)], coalesce(l.rank, {NONE})) else [] end, [coalesce(r.rank, {NONE})], n.ranks[n.head + 2:]) as ranks
    from (
      select word, head, low, ranks, list_concat(ids[1:head - 1], [low], ids[head + 2:]) as ids, case when head > 1 then ids[head - 1] end as before, ids[head + 2] as after
      from (select word, ids, ranks, low, list_position(ranks, low) as head from step where low < {NONE})
    ) n left join pairs l on l.a = n.before and l.b = n.low left join pairs r on r.a = n.low and r.b = n.after
  )
)
select word, ids from step where low = {NONE}
"""

DECODE = "select row, string_agg(t.hex, '' order by place) as hex from tokens join vocabulary t using (token) group by row"


class Tokenizer:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern)
        self.ranks = ranks
        self.tokens = np.array(list(ranks.values()), np.int32)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.bytes = 0
        left, right, rank = [], [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(i)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self._table("pairs", a=left, b=right, rank=rank)
        #: ranks of pairs of single bytes
        self.first = np.full(1 << 16, NONE, np.int32)
        for x in range(1 << 16):
            self.first[x] = ranks.get(x.to_bytes(2, "big"), NONE)
        self.pairs: dict[tuple[int, int], int] = {}
        self.db.register("v", pa.table({"token": pa.array(list(self.bytes_of), pa.int32()), "hex": [t.hex() for t in self.bytes_of.values()]}))
        self.db.execute("create table vocabulary as select * from v")

    def _table(self, name: str, **columns) -> None:
        self.db.register("rows_of_it", pa.table({k: pa.array(np.asarray(v, np.int32)) for k, v in columns.items()}))
        self.db.execute(f"create or replace table {name} as select * from rows_of_it")
        self.db.unregister("rows_of_it")

    def learn(self, words: set[str]) -> None:
        """Encode pre-tokens that aren't known yet; whole tokens need no merge."""
        new = []
        for word in words.difference(self.known):
            raw = word.encode("utf-8", "surrogatepass")
            self.bytes += len(raw)
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[word] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.known[word] = self._merged(raw)
            else:
                new.append((word, raw))
        # pre-tokens of one length need about as many rounds; a query makes ROWS rows at most, whatever the texts
        new.sort(key=lambda x: len(x[1]))
        low = made = 0
        for high, (_, raw) in enumerate(new):
            rows = len(raw) * (len(raw) + 1) // 2
            if made + rows > ROWS:
                self._query(new[low:high])
                low, made = high, 0
            made += rows
        if low < len(new):
            self._query(new[low:])

    def _query(self, new: list[tuple[str, bytes]]) -> None:
        ends = np.cumsum([len(raw) for _, raw in new])
        raw = np.frombuffer(b"".join(raw for _, raw in new), np.uint8)
        token = self.single[raw]
        if (token < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        rank = self.first[np.append(raw[:-1].astype(np.int32) << 8 | raw[1:], 0)]
        rank[ends - 1] = NONE  # a word's last byte has no next one
        cut = pa.array(np.append(0, ends).astype(np.int32))
        self.db.register("start", pa.table({"word": pa.array(np.arange(len(new), dtype=np.int32)), "ids": pa.ListArray.from_arrays(cut, pa.array(token)), "ranks": pa.ListArray.from_arrays(cut, pa.array(rank))}))
        got = self.db.sql(ENCODE).to_arrow_table()
        self.db.unregister("start")
        ids = got.column("ids").combine_chunks()
        flat, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy()
        base = int(ends[0])
        for word, a, b in zip(got.column("word").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            self.known[new[word][0]] = flat[4 * (a - base) : 4 * (b - base)]

    def _merged(self, raw: bytes) -> bytes:
        """Ids of a very long pre-token by a heap of pairs; one contraction a round would take its square.

        The heap's entries are rank and place in one number. An entry whose pair has
        changed meanwhile is passed over. Some 60 times the bytes of ``raw`` are needed.
        """
        if not self.pairs:  # few tasks meet such a word
            self.pairs = {(a, b): r for a, b, r in self.db.execute("select a, b, rank from pairs").fetchall()}
        token = array("i", self.single[np.frombuffer(raw, np.uint8)].tobytes())
        n = len(token)
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := self.pairs.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            key = heapq.heappop(heap)
            rank, i = key >> 32, key & 0xFFFFFFFF
            j = after[i]
            if token[i] < 0 or j >= n or self.pairs.get((token[i], token[j])) != rank:
                continue
            token[i], token[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.pairs.get((token[a], token[b]))) is not None:
                    heapq.heappush(heap, r << 32 | a)
        done = np.frombuffer(token, np.int32)
        return done[done >= 0].astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        block: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) > BLOCK:  # by itself, some pre-tokens at a time
                out += self._ids(block)
                block, size = [], 0
                found = (m.group() for m in self.find.finditer(text))
                out.append(b"".join(self._ids([words])[0] for words in batched(found, BLOCK // 10)))
                continue
            block.append(self.find.findall(text))
            size += len(text)
            if size >= BLOCK or i == len(texts) - 1:
                out += self._ids(block)
                block, size = [], 0
        return out + self._ids(block)

    def _ids(self, block: list[list[str]]) -> list[bytes]:
        if len(self.known) > CACHE or self.bytes > CACHE_BYTES:
            self.known.clear()
            self.bytes = 0
        self.learn(set().union(*block))
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in block]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each row of ids; unknown ids are an error."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        row = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids])
        out: list[list[bytes]] = [[] for _ in ids]
        if not np.isin(flat, self.tokens).all():
            raise ValueError("an id isn't in the vocabulary")
        for low in range(0, len(flat), TOKENS):
            some = slice(low, low + TOKENS)
            self._table("tokens", row=row[some], place=np.arange(len(flat[some])), token=flat[some])
            for r, text in self.db.execute(DECODE).fetchall():
                out[r].append(bytes.fromhex(text))
        return [b"".join(x) for x in out]


@tidy
def _task(batches: Iterator[pa.RecordBatch], path: str, pattern: str, use: Callable) -> Iterator[pa.RecordBatch]:
    tokenizer = None
    for batch in batches:
        if tokenizer is None:
            tokenizer = Tokenizer(load_ranks(path), pattern)
        for low in range(0, batch.num_rows, 1000):
            yield use(tokenizer, batch.slice(low, 1000))


def _with(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns.values()], [*batch.schema.names[:-1], *columns])


def _encode(tokenizer: Tokenizer, batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = tokenizer.encode(pc.fill_null(batch.column(batch.num_columns - 1), "").to_pylist())
    return _with(batch, ids=pa.array(ids, pa.binary()))


def _decode(tokenizer: Tokenizer, batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = pc.fill_null(batch.column(batch.num_columns - 1), b"").to_pylist()
    return _with(batch, decoded=pa.array(tokenizer.decode(ids), pa.binary()))


def _round(tokenizer: Tokenizer, batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = tokenizer.encode(pc.fill_null(batch.column(batch.num_columns - 1), "").to_pylist())
    decoded = tokenizer.decode(ids)
    return _with(batch, ids=pa.array(ids, pa.binary()), decoded=pa.array(decoded, pa.binary()))


def _digest(tokenizer: Tokenizer, batch: pa.RecordBatch) -> pa.RecordBatch:
    done = _round(tokenizer, batch)
    ids, decoded = done.column("ids").to_pylist(), done.column("decoded").to_pylist()
    sha = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())
    return _with(batch, n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()), ids_sha256=sha(ids), decoded_sha256=sha(decoded))


def _apply(df: DataFrame, column: str, added: dict[str, str], path: str, pattern: str, use: Callable) -> DataFrame:
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in added and c != "_in"]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"{c} {t}" for c, t in added.items())])
    rows = df.select(*(F.col(f"`{c}`") for c in kept), F.col(column).alias("_in"))
    return rows.mapInArrow(lambda it: _task(it, path, pattern, use), schema)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``ids``: the token ids of the whole text, little-endian, 4 bytes each.

    Null and empty texts have no ids. Special tokens aren't recognised: their
    strings are ordinary text. A column named ids is replaced. ``path`` must be
    readable by every executor.
    """
    return _apply(docs, text_col, {"ids": "binary"}, path, pattern, _encode)


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``rows`` with ``decoded``, the bytes of ``ids``; null ids give no bytes."""
    return _apply(rows, ids_col, {"decoded": "binary"}, path, pattern, _decode)


def encode_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_tokens, ids_sha256 and decoded_sha256, made in the tasks."""
    return _apply(docs, text_col, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, path, pattern, _digest)
