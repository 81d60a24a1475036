"""Conversations brought back into the order system? (user assistant)+ by the cheapest edits.

Rows come in by conversation and turn, and each is kept (cost 0), gets the role user
or assistant (3) or is deleted (4, the only choice for a blank row or one said
before); empty rows may be inserted (3), and a truncated row that isn't deleted costs
3 more. Four states (nothing yet, after system, after user, after assistant) say
which role may follow. Of the cheapest edits the ones whose initials are least in
ASCII count.

Edits are rebuilt as in Hirschberg ("A linear space algorithm for computing maximal
common subsequences", 1975): a forward vector of four costs and a backward one meet
in the middle, the crossing that is optimal and audit-least is chosen, and both
halves are solved alike. Spark deals rows in blocks, in order, so a conversation may
spread over tasks; a block's four by four costs stand for it when the blocks of a
conversation are joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text_arrays import small_batches, tidy

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
BLOCK_ROWS, BLOCK_CHARS = 2000, 4_000_000
NEVER = 1 << 40
NONE, SYSTEM, USER, ASSISTANT = range(4)
SPOKEN = re.compile(r"[^\x20\x09-\x0D]")
LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
#: What a row or an inserted one turns a state into: role initial to (states before, state after).
NEXT = {"s": ((NONE,), SYSTEM), "u": ((NONE, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
#: Insertions that lead from a state to one in which a conversation may end.
CLOSING = {NONE: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
Vector = tuple[list[int], list[int]]


def _follow(state: int) -> int:
    """The state after an inserted row."""
    return ASSISTANT if state == USER else USER


@lru_cache
def edits(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, initials) of all ways to pass a row, with up to two insertions before it."""
    out = []
    for before in range(4):
        state = before
        for inserted in range(3):
            sofar, cost = "I" * inserted, INSERT * inserted
            out.append((before, state, cost + DELETE, sofar + "D"))
            if fault not in "bd":
                more = CUT if fault == "t" else 0
                for role, own in (("K", initial), ("R", "u"), ("R", "a")):
                    befores, after = NEXT.get(own, ((), 0))
                    if state in befores:
                        out.append((before, after, cost + more + (KEEP if role == "K" else REROLE), sofar + role))
            state = _follow(state)
    return out


def step(vector: Vector, initial: str, fault: str) -> tuple[list[int], list[int], list[int]]:
    """Costs, ranks and origins after one more row. A rank orders the states by their least audits among cheapest."""
    cost, rank = vector
    best: list[tuple | None] = [None] * 4
    for before, after, price, initials in edits(initial, fault):
        if cost[before] < NEVER:
            own = (cost[before] + price, rank[before], initials, before)
            if best[after] is None or own < best[after]:
                best[after] = own
    order = sorted((b[1:3], q) for q, b in enumerate(best) if b)
    ranks = [4] * 4
    for i, (_, q) in enumerate(order):
        ranks[q] = i
    return [b[0] if b else NEVER for b in best], ranks, [b[3] if b else -1 for b in best]


def forward(initials: str, faults: str, low: int, high: int, start: int) -> Vector:
    vector: Vector = ([0 if q == start else NEVER for q in range(4)], [0 if q == start else 4 for q in range(4)])
    for i in range(low, high):
        vector = step(vector, initials[i], faults[i])[:2]
    return vector


def backward(initials: str, faults: str, low: int, high: int, end: int) -> list[int]:
    cost = [0 if q == end else NEVER for q in range(4)]
    for i in range(high - 1, low - 1, -1):
        own = [NEVER] * 4
        for before, after, price, _ in edits(initials[i], faults[i]):
            own[before] = min(own[before], cost[after] + price)
        cost = own
    return cost


def rebuild(initials: str, faults: str, start: int, end: int) -> str:
    """Initials of the cheapest, then ASCII-least edits that lead from one state to another; space linear in the rows."""
    out: list[str] = []
    todo = [(0, len(initials), start, end)]
    while todo:
        low, high, p, q = todo.pop()
        if high - low == 1:
            out.append(min((cost, own) for before, after, cost, own in edits(initials[low], faults[low]) if (before, after) == (p, q))[1])
        elif high > low:
            middle = (low + high) // 2
            cost, rank = forward(initials, faults, low, middle, p)
            rest = backward(initials, faults, middle, high, q)
            cross = min((cost[m] + rest[m], rank[m], m) for m in range(4))[2]
            todo += [(middle, high, cross, q), (low, middle, p, cross)]
    return "".join(out)


def repaired(audit: str, start: int, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the rows that the edits leave or make."""
    out, state, i = [], start, 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            role, state = roles[i], NEXT[roles[i][:1]][1]
        else:
            state = _follow(state)
            role = "assistant" if state == ASSISTANT else "user"
        out.append(f"{role}:{'' if edit == 'I' else texts[i]}")
        i += edit != "I"
    return out


def fault_of(text: str, first: bool) -> str:
    """``b`` blank, ``d`` said before, ``t`` truncated, ``.`` none."""
    if not SPOKEN.search(text):
        return "b"
    if not first:
        return "d"
    return "." if LAST.search(text).group() in ".!?" else "t"


BLOCK = (
    "part long, seq long, initials string, faults string, roles array<string>, texts array<string>, "
    "low_turn long, high_turn long, turns long, costs array<long>, ranks array<long>"
)


class _Block:
    def __init__(self) -> None:
        self.initials, self.faults, self.roles, self.texts, self.turns, self.chars = [], [], [], [], [], 0

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        self.initials.append(role[:1] or "\0")
        self.faults.append(fault_of(text, first))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def row(self, part: int, seq: int, opens: bool) -> tuple:
        """With the costs from each state to each; a conversation that begins here starts in the first one."""
        initials, faults = "".join(self.initials), "".join(self.faults)
        vectors = [forward(initials, faults, 0, len(initials), p) for p in range(1 if opens else 4)]
        low, high = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        return part, seq, initials, faults, self.roles, self.texts, low, high, len(self.turns), [c for v in vectors for c in v[0]], [r for v in vectors for r in v[1]]


def _emitted(rows: list[tuple], convs: list, kind: pa.DataType, names: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(convs, kind), *(pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), names.values(), strict=True))]
    return pa.RecordBatch.from_arrays(columns, ["_conv", *names])


_TEXTS, _LONGS = pa.list_(pa.string()), pa.list_(pa.int64())
_BLOCK_TYPES = {
    "part": pa.int64(), "seq": pa.int64(), "initials": pa.string(), "faults": pa.string(), "roles": _TEXTS, "texts": _TEXTS,
    "low_turn": pa.int64(), "high_turn": pa.int64(), "turns": pa.int64(), "costs": _LONGS, "ranks": _LONGS,
}


@tidy
def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, turn, role, text, copies, first) into blocks, in order."""
    part, seq, block, conv, opens = TaskContext.get().partitionId(), 0, None, None, False
    for batch in batches:
        kind = batch.schema.field(0).type
        for own, turn, role, text, copies, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for copy in range(copies):
                if block and (own != conv or len(block.faults) >= rows or block.chars > BLOCK_CHARS):
                    yield _emitted([block.row(part, seq, opens)], [conv], kind, _BLOCK_TYPES)
                    seq, opens, block = seq + 1, own != conv, None
                if not block:
                    block, conv = _Block(), own
                block.add(turn, role, text, first and not copy)
    if block:
        yield _emitted([block.row(part, seq, opens)], [conv], kind, _BLOCK_TYPES)


def joined(blocks: list[dict]) -> tuple[int, list[tuple[int, int, int, int]], int]:
    """Cost, (part, seq, state before, state after) of each block of a conversation in order, and insertions at its end."""
    cost, rank = [0, NEVER, NEVER, NEVER], [0, 4, 4, 4]
    origins = []
    for b in blocks:
        best: list[tuple | None] = [None] * 4
        for p in range(len(b["costs"]) // 4):
            for q in range(4):
                price = b["costs"][4 * p + q]
                if cost[p] < NEVER and price < NEVER:
                    own = (cost[p] + price, rank[p], b["ranks"][4 * p + q], p)
                    if best[q] is None or own < best[q]:
                        best[q] = own
        order = sorted((x[1:3], q) for q, x in enumerate(best) if x)
        cost, rank = [x[0] if x else NEVER for x in best], [4] * 4
        for i, (_, q) in enumerate(order):
            rank[q] = i
        origins.append([x[3] if x else -1 for x in best])
    total, _, state = min((cost[q] + INSERT * CLOSING[q], rank[q], q) for q in range(4))
    closing, path = CLOSING[state], []
    for b, origin in zip(reversed(blocks), reversed(origins), strict=True):
        path.append((b["part"], b["seq"], origin[state], state))
        state = origin[state]
    return total, path[::-1], closing


_PATH = pa.list_(pa.struct([(x, pa.int64()) for x in ("part", "seq", "before", "after", "closing")]))


@tidy
def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, blocks) into (conv, gaps, illegal, cost, path)."""
    for batch in batches:
        rows = []
        for blocks in batch.column(1).to_pylist():
            pairs = sum(x["illegal"] for x in blocks) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(blocks, blocks[1:], strict=False))
            timed = [b for b in blocks if b["turns"]]
            turns = sum(b["turns"] for b in timed) - sum(a["high_turn"] == b["low_turn"] for a, b in zip(timed, timed[1:], strict=False))
            gaps = timed[-1]["high_turn"] - timed[0]["low_turn"] + 1 - turns if timed else 0
            cost, path, closing = joined(blocks)
            path = [(*x, closing if i == len(path) - 1 else 0) for i, x in enumerate(path)]
            rows.append((gaps, pairs, cost, [dict(zip(("part", "seq", "before", "after", "closing"), x, strict=True)) for x in path]))
        if rows:
            yield _emitted(rows, batch.column(0).to_pylist(), batch.schema.field(0).type, {"gaps": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "path": _PATH})


@tidy
def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their states into (conv, part, seq, audit, lines)."""
    for batch in batches:
        for i in range(batch.num_rows):
            conv, part, seq, initials, faults, roles, texts, before, after, closing = (c[i].as_py() for c in batch.columns)
            audit = rebuild(initials, faults, before, after) + "I" * closing
            out = (part, seq, audit, repaired(audit, before, roles, texts))
            yield _emitted([out], [conv], batch.schema.field(0).type, {"part": pa.int64(), "seq": pa.int64(), "audit": pa.string(), "lines": _TEXTS})


@tidy
def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, part, seq, audit, lines) into (conv, audit, repaired_sha256), one block in memory at a time."""
    now, conv, done = None, None, []
    names = {"audit": pa.string(), "repaired_sha256": pa.string()}

    def close() -> None:
        if now:
            done.append(("".join(now[0]), now[1].hexdigest()))
            convs.append(conv)

    kind, convs = pa.int64(), []
    for batch in batches:
        kind = batch.schema.field(0).type
        for i in range(batch.num_rows):
            own, _, _, audit, lines = (c[i].as_py() for c in batch.columns)
            if not now or own != conv:
                close()
                now, conv, said = ([], hashlib.sha256()), own, False
            now[0].append(audit)
            for line in lines:
                now[1].update(("\n" + line if said else line).encode("utf-8", "surrogatepass"))
                said = True
        if done:
            yield _emitted(done, convs, kind, names)
            done, convs = [], []
    close()
    if done:
        yield _emitted(done, convs, kind, names)


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", conversations: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand by turn, nulls first, then role and text; null roles and texts are one
    space, a null conversation id is an id like any other. ``gaps`` counts missing
    turn numbers, ``illegal`` neighbours whose roles may not follow each other;
    blank, duplicate and truncated count each row's first fault. ``audit`` has the
    edits' initials (Keep, Rerole, Delete, Insert), ``repaired_sha256`` digests the
    repaired ``role:text`` lines. Ids of ``conversations`` without rows get zeros, an
    empty audit and the digest of nothing. Other columns are ignored; an empty table
    stays empty. A task holds ``block_rows`` rows of a conversation at once, and of
    each of its blocks 32 numbers; its audit is one string.
    """
    spark = turns.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "repair")
    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
    one = rows.groupBy("_conv", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("said", F.md5("text"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # what is said before is found by counting, not in a window, so that no conversation or text is one task's
    first = one.groupBy(F.col("_conv").alias("c"), F.col("role").alias("r"), F.col("said").alias("s")).agg(F.min(when).alias("first"))
    same = one["_conv"].eqNullSafe(F.col("c")) & (one["role"] == F.col("r")) & (one["said"] == F.col("s"))
    marked = scratch.save(one.join(first, same).select("_conv", "turn", "role", "text", F.col("copies").cast("int"), when.eqNullSafe(F.col("first")).alias("first")))
    order = [F.col("_conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    kind = marked.schema["_conv"].dataType.simpleString()
    placed = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = scratch.save(placed.mapInArrow(lambda it: _blocks(it, block_rows), f"_conv {kind}, {BLOCK}"))
    pair = F.expr("size(filter(sequence(1, length(initials) - 1), i -> i > 0 and substr(initials, i, 2) not in ('su', 'ua', 'au')))")
    brief = F.struct(
        "part", "seq", F.when(F.length("initials") > 1, pair).otherwise(0).alias("illegal"), F.expr("left(initials, 1)").alias("first"), F.expr("right(initials, 1)").alias("last"),
        "low_turn", "high_turn", "turns", "costs", "ranks",
    )
    count = lambda c: F.sum(F.length("faults") - F.length(F.translate("faults", c, ""))).cast("long")
    convs = blocks.groupBy("_conv").agg(F.array_sort(F.collect_list(brief)).alias("blocks"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
    path = "array<struct<part: long, seq: long, before: long, after: long, closing: long>>"
    convs = scratch.save(convs)
    solved = scratch.save(convs.select("_conv", "blocks").mapInArrow(_paths, f"_conv {kind}, gaps long, illegal long, cost long, path {path}"))
    states = solved.select(F.explode("path").alias("p")).select("p.*")
    full = blocks.join(states, ["part", "seq"]).select("_conv", "part", "seq", "initials", "faults", "roles", "texts", "before", "after", "closing")
    lines = full.mapInArrow(_rebuilt, f"_conv {kind}, part long, seq long, audit string, lines array<string>")
    ended = lines.repartition("_conv").sortWithinPartitions("_conv", "part", "seq").mapInArrow(_digested, f"_conv {kind}, audit string, repaired_sha256 string")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = [convs.select("_conv", "blank", "duplicate", "truncated"), solved.select("_conv", "gaps", "illegal", "cost"), ended]
    if conversations is not None:
        every.append(conversations.select(F.col(conv_col).alias("_conv")))
    told = every[0]
    for more in every[1:]:
        told = told.unionByName(more, allowMissingColumns=True)
    per = told.groupBy("_conv").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return per.withColumnRenamed("_conv", conv_col)
