"""Near-duplicate documents by HyperMinHash signatures (Yu & Weber, 2017).

Plan:

1. One pass makes each text's set of shingle hashes and keeps of it the size, a
   128-bit digest and 256 registers; a register is the leading-zero count and
   ten mantissa bits of the smallest hash in its bucket. Texts with equal sets
   form a class, and only classes go on.
2. Registers are banded. Sets of ``LARGE`` shingles and more: 32 bands of 8
   registers, so a pair at 0.85 shares no band with a chance of 4e-5. Smaller
   sets go by size class; within a class at most D shingles can differ between
   linked sets, so of D + 4 bands four at least are equal.
3. Every class of a band that several share is compared with the band's hub, the
   class of most copies, and the links with hubs make components. A band whose
   classes are in one component is done, so a group of copies costs as much as it
   has members. In other bands all pairs of different components are compared, in
   blocks of bounded size: also what failed at the hub with what is linked with it.
4. A pair is dropped early if its collision-corrected Jaccard estimate lies five
   standard deviations under the threshold; else its full sets decide.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bit_table import bit_table, may_hold
from .components import connected_components
from .scratch import Scratch
from .text_arrays import SPACE_SPLIT, Words, mix, small_batches, text_chunks, tidy

REGISTERS, MANTISSA, ROWS = 256, 10, 8
#: From so many shingles on, the fixed bands hold four each; what has fewer is banded by size.
LARGE = 128
#: Standard deviations under the threshold at which an estimate drops a pair.
SLACK = 5
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of a chunk, sorted by both."""
    words = Words(data, offsets, SPACE_SPLIT)
    grams = words.grams(k)
    at = words.gram_starts(k)
    rows, hashes = [words.doc[at]], [grams[at]]
    for short in range(1, k):
        own = np.flatnonzero(words.count == short)
        if len(own):
            rows.append(own)
            hashes.append(words.grams(short)[words.first[own]])
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def registers(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """HyperMinHash registers of n rows; 0 is an empty bucket."""
    bucket = (value >> _U(56)).astype(np.int64)
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    row, bucket, rest = row[first], bucket[first], (value[first] << _U(8)) >> _U(11)
    zeros = 53 - np.frexp(rest.astype(np.float64))[1]
    top = (rest << zeros.astype(_U)) & _U((1 << 52) - 1)
    kept = (zeros << MANTISSA | (top >> _U(52 - MANTISSA)).astype(np.int64)) + 1
    out = np.zeros((n, REGISTERS), np.uint16)
    out[row, bucket] = kept
    return out


@tidy
def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for rows, data, offsets in text_chunks(batch, "_text"):
            n = rows.stop - rows.start
            row, value = shingle_sets(data, offsets, k)
            size = np.bincount(row, minlength=n)
            some = np.flatnonzero(size)
            begin = (np.cumsum(size) - size)[some]
            digest = np.zeros((2, n), _U)
            if len(some):
                digest[0, some] = mix(np.add.reduceat(value, begin) + size[some].astype(_U))
                digest[1, some] = np.add.reduceat(mix(value ^ _U(0x5851F42D4C957F2D)), begin)
            regs = registers(row, value, n)
            regs = regs.view(np.int16).reshape(-1)
            regs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * REGISTERS), pa.array(regs))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(rows.start, n), pa.array(size.astype(np.int64)), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), regs],
                ["_id", "n", "c", "c2", "regs"],
            )


def size_classes(limit: int, percent: int) -> list[int]:
    """Class bounds such that linked sizes fall in the same or in neighbouring classes."""
    bounds = [1, 2]
    while bounds[-1] <= limit:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * 100 // percent + 1))
    return bounds


def _begins(bands: int) -> np.ndarray:
    """First register of each band."""
    return -(-np.arange(bands) * REGISTERS // bands)


@tidy
def _bands(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    bounds = size_classes(LARGE * 2, percent)
    salt = mix(np.arange(1, REGISTERS + 1, dtype=_U) << _U(20))
    for batch in batches:
        ids, size, copies = (batch.column(c).to_numpy() for c in ("c", "n", "copies"))
        flat = batch.column("regs").flatten().to_numpy().view(np.uint16)
        regs = flat.reshape(-1, REGISTERS).astype(_U)
        hashed = np.where(regs > 0, mix(regs + salt), _U(0))
        plans: dict[tuple[int, int], list[int]] = {}
        for i, n in enumerate(size.tolist()):
            if n >= LARGE * percent // 100:
                plans.setdefault((-1, REGISTERS // ROWS), []).append(i)
            if n < LARGE:
                at = bisect.bisect_right(bounds, n) - 1
                for c in (at, at + 1):
                    differ = (100 - percent) * (bounds[c + 1] - 1) // percent
                    if differ:
                        plans.setdefault((c, differ + 4), []).append(i)
        keys, owners, slots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (c, bands), own in plans.items():
            sums = np.add.reduceat(hashed[own], _begins(bands), axis=1)
            named = mix(sums + mix(np.arange(bands, dtype=_U) * _U(1 << 32) + _U(c + 2)))
            some = sums != 0
            keys.append(named[some].view(np.int64))
            owners.append(np.repeat(np.array(own), bands).reshape(len(own), bands)[some])
            slots.append(np.tile(np.arange(bands) << 16 | bands, (len(own), 1))[some])
        owner = np.concatenate(owners)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids[owner]), pa.array(copies[owner].astype(np.int32)), pa.array(np.concatenate(slots).astype(np.int32))], ["key", "c", "copies", "slot"])


def may_link(percent: int, a: str = "a", b: str = "b") -> Column:
    """Do sizes and the collision-corrected estimate of two rows' registers allow a link?

    Columns ``n_a, regs_a, n_b, regs_b``. Of the registers that either row uses,
    equal ones count as shared, less those that equal by chance: 0.16992 * 2**-10
    of them times 4xy / (x + y)**2 for sets of x and y shingles. The deviation is
    that of drawing as many of the union's shingles as registers are used.
    """
    j = percent / 100
    return F.expr(
        f"""n_{a} * 100 >= n_{b} * {percent} and n_{b} * 100 >= n_{a} * {percent} and
        aggregate(zip_with(regs_{a}, regs_{b}, (x, y) -> case when x = 0 and y = 0 then 0 when x = y then 1001 else 1000 end), 0, (s, v) -> s + v,
          s -> (s % 1000) - (s div 1000) * 0.16992 / 1024 * 4e0 * n_{a} * n_{b} / pow(n_{a} + n_{b}, 2)
               >= (s div 1000) * {j} - {SLACK} * sqrt((s div 1000) * {j * (1 - j)} * greatest(0.05, 1 - (s div 1000) * {1 + j} / (n_{a} + n_{b}))))"""
    )


@tidy
def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that ``may_link``, out of rows sorted by band and pair of blocks.

    Rows of one band and pair of blocks are a run, of twice ``BLOCK`` rows or so. A
    pair is given out in the first of its common bands only, and not at all if both
    have the same ``own``, the component that the hubs have made.
    """
    j = percent / 100
    names = ("key", "low", "high", "block", "c", "own", "slot", "n")
    rest: list[np.ndarray] | None = None

    def run(x: dict[str, np.ndarray], regs: np.ndarray, out: list[np.ndarray]) -> None:
        cross, bands, band = x["low"][0] != x["high"][0], int(x["slot"][0] & 0xFFFF), int(x["slot"][0] >> 16)
        begins, used = _begins(bands), regs != 0
        for i in range(len(regs) - 1):
            n = x["n"][i + 1 :]
            ok = (x["own"][i + 1 :] != x["own"][i]) & (n * 100 >= x["n"][i] * percent) & (x["n"][i] * 100 >= n * percent)
            if cross:
                ok &= x["block"][i + 1 :] != x["block"][i]
            at = np.flatnonzero(ok) + i + 1
            if not len(at):
                continue
            equal = regs[at] == regs[i]
            either = (used[at] | used[i]).sum(axis=1)
            same = (equal & used[i]).sum(axis=1)
            chance = either * 0.16992 / 1024 * 4.0 * x["n"][at] * x["n"][i] / (x["n"][at] + x["n"][i]) ** 2.0
            unseen = np.maximum(0.05, 1 - either * (1 + j) / (x["n"][at] + x["n"][i]))
            near = np.flatnonzero(same - chance >= either * j - SLACK * np.sqrt(either * j * (1 - j) * unseen))
            if len(near):
                shared = np.logical_and.reduceat(equal[near], begins, axis=1) & np.logical_or.reduceat(used[i], begins)
                other = x["c"][at[near[shared.argmax(axis=1) == band]]]
                out.append(np.stack([np.minimum(other, x["c"][i]), np.maximum(other, x["c"][i])]))

    def pairs(cols: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        x, regs = dict(zip(names, cols, strict=False)), cols[-1]
        new = np.ones(len(regs), bool)
        new[1:] = (x["key"][1:] != x["key"][:-1]) | (x["low"][1:] != x["low"][:-1]) | (x["high"][1:] != x["high"][:-1])
        edges = np.append(np.flatnonzero(new), len(regs)) if len(regs) else np.zeros(1, np.int64)
        out = [np.zeros((2, 0), np.int64)]
        done = len(edges) - 1 if last else max(0, len(edges) - 2)
        for a, b in zip(edges[:done], edges[1 : done + 1], strict=True):
            if b - a > 1:
                run({k: v[a:b] for k, v in x.items()}, regs[a:b], out)
        both = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"]), [v[edges[done] :] for v in cols]

    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in names] + [batch.column("regs").flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS)]
        done, rest = pairs(cols if rest is None else [np.concatenate(v) for v in zip(rest, cols, strict=True)], False)
        yield done
    if rest is not None:
        yield pairs(rest, True)[0]


def _renamed(df: DataFrame, end: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(end if c == "c" else f"{c}_{end}") for c in columns))


#: Classes of a band that are compared in one place; a band of more is cut into blocks, and blocks are paired.
BLOCK = 512


def _verified(found: DataFrame, texts: DataFrame, regs: DataFrame, percent: int, shingle: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of ``found`` whose full sets are linked, written."""
    found = scratch.save(found)
    ids = found.select(F.col("a").alias("c")).union(found.select("b")).distinct()
    wanted = scratch.save(regs.join(ids, "c", "left_semi").select(F.col("least_id").alias("_id")).distinct())
    # most other texts are dropped before the join shuffles any
    bits = bit_table(wanted.select(F.xxhash64("_id").alias("h")), "h")
    kind = texts.schema["_id"].dataType.simpleString()
    some = texts.select(F.xxhash64("_id").alias("h"), "_id", "_text").mapInArrow(lambda it: _maybe(it, bits), f"_id {kind}, _text string")
    own = some.join(wanted, "_id", "left_semi").mapInArrow(lambda it: _sets(it, shingle), "c long, c2 long, n long, shingles array<long>")
    sets = scratch.save(own.withColumn("c", F.xxhash64("c", "c2", "n")).select("c", "shingles"))
    both = found.join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = scratch.save(both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * percent).select("a", "b"))
    scratch.drop(found, wanted, sets)
    return links


def _with_hubs(bands: DataFrame) -> DataFrame:
    """The rows of bands that several classes share, each with the band's hub."""
    hubs = bands.groupBy("key").agg(F.min(F.struct(-F.col("copies"), F.col("c"))).getField("c").alias("hub"), F.count("*").alias("m")).where("m > 1").select("key", "hub")
    return bands.join(hubs, "key").select("key", "c", "slot", "hub")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, shingle: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Texts are lower-cased in A-Z and split at ASCII white space; a set holds the
    distinct shingles of ``shingle`` words, or the whole sequence of a shorter
    text. Sets A, B are linked if 100 * |A & B| >= percent * |A | B|.

    * null or wordless text: n_shingles 0, a component of its own, kept
    * equal texts, repeated ids: one component; each row is returned
    * component_id is the smallest id in the component; a row without id isn't kept
    * other columns of ``docs`` are ignored; an empty table gives an empty result
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "neardup")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = texts.schema["_id"].dataType.simpleString()
    signed = scratch.save(
        texts.mapInArrow(lambda it: _signatures(it, shingle), f"_id {id_type}, n long, c long, c2 long, regs array<short>")
    )
    signed = signed.withColumn("c", F.xxhash64("c", "c2", "n"))
    filled = signed.where("n > 0")
    names = filled.groupBy("c").agg(F.min("_id").alias("least_id"), F.count("*").alias("copies"))
    classes = scratch.save(filled.groupBy("c").agg(F.min("_id").alias("least_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    bands = scratch.save(classes.select("c", "n", "copies", "regs").mapInArrow(lambda it: _bands(it, percent), "key long, c long, copies int, slot int"))
    live = scratch.save(_with_hubs(bands))
    scratch.drop(bands)
    regs = scratch.save(classes.join(live.select("c").distinct(), "c", "left_semi").select("c", "n", "regs", "least_id"))
    scratch.drop(classes)
    rows = regs.select("c", "n", "regs")
    # first, each band's classes with its hub
    asked = live.where("c <> hub")
    tests = asked.select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct()
    found = tests.join(_renamed(rows, "b", "c", "n", "regs"), "b").join(_renamed(rows, "a", "c", "n", "regs"), "a").where(may_link(percent)).select("a", "b")
    with_hub = _verified(found, texts, regs, percent, shingle, scratch)
    # then the bands in which classes of several components meet, pair by pair, but for pairs within a component
    own = connected_components(with_hub, scratch).select(F.col("node").alias("c"), F.col("root").alias("own"))
    named_hubs = own.select(F.col("c").alias("hub"), F.col("own").alias("main"))
    left = asked.join(own, "c", "left").join(named_hubs, "hub", "left").select("key", "c", "slot", F.coalesce("own", "c").alias("own"), F.coalesce("main", "hub").alias("main"))
    left = scratch.save(left)
    scratch.drop(live)
    # a band's rows in the hub's component meet the others only; the others meet all
    others = F.count_if(F.col("own") != F.col("main"))
    size = left.groupBy("key").agg(F.count("*").alias("m"), others.alias("r"), F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi")
    blocks = size.select("key", F.ceil(F.col("r") / BLOCK).cast("int").alias("rest"), F.when(F.col("m") <= BLOCK, 0).otherwise(F.ceil((F.col("m") - F.col("r")) / BLOCK)).cast("int").alias("mains"))
    member = left.join(blocks, "key").join(rows, "c").withColumn("inner", (F.col("own") == F.col("main")) & (F.col("mains") > 0))
    member = member.withColumn("block", F.expr("if(inner, rest + pmod(xxhash64(c), mains), pmod(xxhash64(c), rest))").cast("int"))
    member = member.withColumn("other", F.explode(F.expr("sequence(0, if(inner, rest, rest + mains) - 1)")))
    dealt = member.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "c", "own", "slot", "n", "regs")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = dealt.mapInArrow(lambda it: _pairs(it, percent), "a long, b long").distinct()
    links = with_hub.unionByName(_verified(found, texts, regs, percent, shingle, scratch))
    roots = scratch.save(connected_components(links, scratch))
    named = names.join(roots, names.c == roots.node, "left").select("c", "least_id", F.coalesce("root", "c").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    grouped = scratch.save(named.join(lowest, "root").select("c", "component_id"))
    out = signed.select("_id", "n", "c").join(grouped, "c", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(False)).alias("kept"),
    )


def _maybe(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) whose hashed id may be in ``bits``."""
    for batch in batches:
        yield batch.select([1, 2]).filter(pa.array(may_hold(bits, batch.column(0).to_numpy().view(_U))))


@tidy
def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sets under the digest of ``_signatures``; one of each digest in a batch."""
    for batch in batches:
        for rows, data, offsets in text_chunks(batch, "_text"):
            n = rows.stop - rows.start
            row, value = shingle_sets(data, offsets, k)
            size = np.bincount(row, minlength=n)
            some = np.flatnonzero(size)
            if not len(some):
                continue
            begin = (np.cumsum(size) - size)[some]
            c = mix(np.add.reduceat(value, begin) + size[some].astype(_U))
            c2 = np.add.reduceat(mix(value ^ _U(0x5851F42D4C957F2D)), begin)
            ends = np.append(0, np.cumsum(size[some])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(size[some].astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))],
                ["c", "c2", "n", "shingles"],
            )
