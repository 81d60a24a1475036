"""Benchmark decontamination by winnowing (Schleimer, Wilkerson & Aiken, 2003).

Of the hashes of all ``k``-word grams, each run of ``window - k + 1`` neighbours
keeps the smallest, the rightmost of equals; neighbouring runs mostly keep the same
one, so about a third of all grams is left. Two texts that share ``window`` words
keep the same gram at the same place of the shared words. Kept grams of documents
and of items are joined by their hash, and each hit is extended word by word to
both sides, as far as ``window - k`` words; a hit that grows to ``window`` words or
more is an occurrence of all windows within. Items with fewer words than a window
are fingerprinted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bit_table import bit_table, may_hold
from .text_arrays import ALNUM_SPLIT, Words, mix, small_batches, text_chunks, tidy

_U = np.uint64


def winnow(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that some run of ``window`` words of a row keeps, each once."""
    starts = words.gram_starts(window)
    grams = words.grams(k)
    if not len(starts):
        return starts, np.zeros(0, _U)
    best, place = grams[starts].copy(), starts.copy()
    for j in range(1, window - k + 1):
        other = grams[starts + j]
        lower = other <= best
        best[lower] = other[lower]
        place[lower] = starts[lower] + j
    place = np.unique(place)
    return place, grams[place]


def _beside(words: Words, at: np.ndarray, first: np.ndarray, step: int, reach: int) -> pa.Array:
    """Hashes of up to ``reach`` words of the same row, from word ``first`` on in direction ``step``, nearest first."""
    doc = words.doc[at]
    end = words.first[doc] + words.count[doc]
    places = first[:, None] + step * np.arange(reach)[None, :]
    there = (places >= words.first[doc][:, None]) & (places < end[:, None])
    flat = words.hash[places[there]].view(np.int64) if there.any() else np.zeros(0, np.int64)
    ends = np.append(0, np.cumsum(there.sum(axis=1))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


@tidy
def _fingerprints(batches: Iterator[pa.RecordBatch], k: int, window: int, short: list[int], bits: bytes | None) -> Iterator[pa.RecordBatch]:
    """Rows (id, n_words, at, length, need, fp, before, after): the kept grams, and a row with at -1 for each text.

    ``before`` and ``after`` hold the hashes of the words beside the gram; a hit has
    to grow to ``need`` words. ``short`` lists lengths below ``window`` whose grams are
    all kept and need no more than themselves. ``bits`` drops fingerprints that
    can't join.
    """
    for batch in batches:
        ids = batch.column(0)
        for rows, data, offsets in text_chunks(batch, "_text"):
            n = rows.stop - rows.start
            words = Words(data, offsets, ALNUM_SPLIT)
            found = [(*winnow(words, k, window), k, window)]
            for length in short:
                at = words.gram_starts(length)
                found.append((at, mix(words.grams(length)[at] + _U(length)), length, length))
            nothing = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array(np.zeros(0, np.int64)))
            out = [(np.arange(n), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), mix(np.arange(n, dtype=_U)), nothing, nothing)]
            for at, fp, length, need in found:
                if bits is not None:
                    hit = may_hold(bits, fp)
                    at, fp = at[hit], fp[hit]
                if len(at):
                    doc, same = words.doc[at], np.full(len(at), length)
                    out.append((doc, at - words.first[doc], same, np.full(len(at), need), fp, _beside(words, at, at - 1, -1, need - length), _beside(words, at, at + length, 1, need - length)))
            doc, at, length, need, fp = (np.concatenate([o[i] for o in out]) for i in range(5))
            before, after = (pa.concat_arrays([o[i] for o in out]) for i in (5, 6))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(doc + rows.start)), pa.array(words.count[doc]), pa.array(at.astype(np.int64)), pa.array(length.astype(np.int32)), pa.array(need.astype(np.int32)), pa.array(fp.view(np.int64)), before, after],
                ["_id", "n_words", "at", "length", "need", "fp", "before", "after"],
            )


def _table(df: DataFrame, id_col: str, text_col: str, k: int, window: int, short: list[int], bits: bytes | None = None) -> DataFrame:
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _fingerprints(it, k, window, short, bits), f"_id {kind}, n_words long, at long, length int, need int, fp long, before array<long>, after array<long>")


def benchmark_grams(benchmark: DataFrame, k: int, window: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """(item_id, need, fp, before, after) of the kept grams of every item, and the lengths below ``window`` that occur."""
    size = _table(benchmark, id_col, text_col, k, window, [])
    short = sorted(r[0] for r in size.where(f"at = -1 and n_words between 1 and {window - 1}").select(F.col("n_words").cast("int")).distinct().collect())
    own = _table(benchmark, id_col, text_col, k, window, short).where(f"at >= 0 and (need = {window} or need = n_words)")
    return own.select(F.col("_id").alias("item_id"), "need", "fp", "before", "after").distinct(), short


def _agreeing(x: str, y: str) -> Column:
    """How many first elements of two arrays are equal."""
    differs = f"array_position(transform(arrays_zip({x}, {y}), z -> coalesce(z.{x} = z.{y}, false)), false)"
    return F.expr(f"cast(case when {differs} > 0 then {differs} - 1 else size({x}) end as long)")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, k: int = 6, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per id of ``docs``: n_words, n_hit, n_items, items (sorted as strings, comma-joined), contaminated.

    Words are runs of digits, letters a-z (after lower-casing A-Z) and all
    characters beyond ASCII. A benchmark item's windows are its runs of
    ``window`` words, or the whole item if it has fewer; a document's word is hit
    if an occurrence of a window covers it.

    * null or wordless texts have no words and no hits; such items have no windows
    * repeated windows count once; rows that repeat an id, or lack one, count as one document
    * a text is handled whole in its task, in memory of some 20 times its bytes
    * an empty benchmark hits nothing; other columns are ignored
    """
    small_batches(docs.sparkSession)
    if not 0 < k < window:
        raise ValueError("k has to be less than the window")
    grams, short = benchmark_grams(benchmark, k, window, item_col, item_text_col)
    # items that agree in a gram and in all words beside it are hit together: a document meets one of them
    named = grams.withColumn("place", F.xxhash64("fp", "need", "before", "after"))
    items = named.select("place", F.col("item_id").cast("string").alias("item")).distinct()
    places = named.select("fp", "need", F.col("before").alias("left"), F.col("after").alias("right"), "place").distinct()
    found = _table(docs, id_col, text_col, k, window, short, bit_table(grams, "fp"))
    joined = found.join(places, ["fp", "need"], "left").where("at = -1 or place is not null")
    grown = joined.select("_id", "n_words", "at", "length", "need", "place", _agreeing("before", "left").alias("l"), _agreeing("after", "right").alias("r"))
    hits = grown.where("at = -1 or l + length + r >= need").select("_id", "n_words", F.expr("if(at = -1, -1, at - l)").alias("low"), F.expr("at + length + r").alias("high"), "place")
    order = W.partitionBy("_id").orderBy("low", "high")
    reach = F.coalesce(F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = F.when(F.col("low") >= 0, F.greatest(F.lit(0), F.col("high") - F.greatest(F.col("low"), reach))).otherwise(0)
    # the places of a document are no more than its words; a document without any keeps its row
    counted = hits.withColumn("fresh", fresh).groupBy("_id").agg(F.max("n_words").alias("n_words"), F.sum("fresh").alias("n_hit"), F.collect_set("place").alias("places"))
    placed = counted.select("_id", "n_words", "n_hit", F.explode_outer("places").alias("place")).join(items, "place", "left")
    per = placed.groupBy("_id").agg(F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("of"))
    return per.select(
        F.col("_id").alias(id_col), "n_words", F.col("n_hit").cast("long"), F.size("of").cast("long").alias("n_items"),
        F.array_join("of", ",").alias("items"), (F.col("n_hit") > 0).alias("contaminated"),
    )
