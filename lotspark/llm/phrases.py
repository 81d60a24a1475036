"""Phrase collocations by Toivonen's mining ("Sampling large databases for association rules", 1996).

A part of the pieces of text, ``SHARE`` of them, proposes the phrases that seem
frequent at a lowered threshold. A full pass then counts exactly every proposed
phrase and the negative border: phrases whose first and last ``k - 1`` words are both
proposed while they themselves aren't. Where a phrase of the border proves to be
frequent, its extensions haven't been counted; it joins the proposed ones and
another full pass counts what has become a candidate by that, until no border fails.
A frequent phrase has frequent parts only, so nothing is missed, whatever the sample.

Proposed phrases go to the tasks as a table of bits of one fixed size: it may
propose some more, never fewer. Counts are exchanged by ``gram_counts``, by hash
only; the counting task names one chunk of text for each frequent phrase, and a
last pass spells it there, not in every chunk that holds it. Chunks are known by
their content. If texts come in other chunks by then, what is left is spelled wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bit_table import bit_table, may_hold
from .gram_counts import SENT, frequent, place, sent, summed
from .scratch import Scratch
from .text_arrays import Words, byte_class, cut_chunks, mix, small_batches, tidy

_U = np.uint64
_FACTOR = _U(0xD6E8FEB86659FD93)
LEAST, LONGEST, TOP = 100, 5, 2000
#: Of the pieces of text, the part that proposes, and the part of the threshold that it has to reach there.
SHARE, LOWERED = 1 / 16, 0.5
#: The proposed phrases go to the tasks in 2 MB, whatever their number.
TABLE_BITS = 24
#: Bits for each frequent phrase in the two tables of places, and the exponent that they stop at, 16 MB.
PLACE_BITS, MOST_BITS = 16, 27
#: Bytes of text whose keys meet in one task, about.
BUCKET_BYTES = 8_000_000
CHUNK = 2 << 20

BREAKS = ".,;:!?\n\x0b\x0c\r"
WORD_BYTES = byte_class(BREAKS + " \t")
BREAK_BYTES = ~byte_class(BREAKS)


class Phrases:
    """Keys of all phrases of a chunk, by language: ``key[k]`` of the k words from each word on, ``whole[k]``: they stand in one piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str], longest: int):
        self.words = w = Words(data, offsets, WORD_BYTES)
        lang = np.array([xxhash.xxh64_intdigest(x) for x in langs], _U)
        h = mix(w.hash ^ lang[w.doc]) if len(w.hash) else w.hash
        piece = np.cumsum(BREAK_BYTES[data])[w.start]
        joined = (piece[1:] == piece[:-1]) & (w.doc[1:] == w.doc[:-1])
        self.key, self.whole = {1: h}, {1: np.ones(len(h), bool)}
        for k in range(2, longest + 1):
            size = max(0, len(h) - k + 1)
            self.key[k] = mix(self.key[k - 1][:size] * _FACTOR + h[k - 1 :] + _U(k))
            self.whole[k] = self.whole[k - 1][:size] & joined[k - 2 :] if size else np.zeros(0, bool)

    def candidates(self, k: int, held: dict[int, np.ndarray]) -> np.ndarray:
        """Places whose first and last k - 1 words are both held."""
        size = len(self.key[k])
        return self.whole[k] & held[k - 1][:size] & held[k - 1][1 : size + 1]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    for batch in batches:
        langs = batch.column(0)
        for rows, data, offsets, _, _ in cut_chunks(batch, "_text", BREAK_BYTES, CHUNK):
            yield data, offsets, langs.slice(rows.start, rows.stop - rows.start).to_pylist()


def _name(data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> np.uint64:
    """A hash of all that a chunk holds."""
    h = xxhash.xxh64(np.ascontiguousarray(data))
    h.update(np.ascontiguousarray(offsets))
    h.update("\0".join(langs).encode("utf-8", "surrogatepass"))
    return _U(h.intdigest())


def _sampled(data: np.ndarray, offsets: np.ndarray, share: float, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A part of the chunk's pieces; each stands or falls by its place."""
    doc = np.zeros(len(data), np.int64)
    starts = offsets[1:-1]
    np.add.at(doc, starts[starts < len(data)], 1)
    ends = BREAK_BYTES[data]
    piece = np.cumsum(doc + np.append(False, ends[:-1])) if len(data) else doc
    number = np.arange(int(piece[-1]) + 1 if len(data) else 0, dtype=_U)
    keep = (mix(number + mix(np.array([salt], _U))) >> _U(32)).astype(np.float64) < share * 2**32
    kept = keep[piece]
    before = np.append(0, np.cumsum(kept))
    return data[kept], before[offsets]


@tidy
def _counted(batches: Iterator[pa.RecordBatch], longest: int, buckets: int, bits: bytes | None, last: bytes | None, share: float) -> Iterator[pa.RecordBatch]:
    """Rows of ``gram_counts.SENT``. Without ``bits``: all phrases of a sample; with ``last``, only what that table didn't make a candidate."""
    for number, (data, offsets, langs) in enumerate(_texts(batches)):
        chunk = _name(data, offsets, langs)
        if bits is None:
            data, offsets = _sampled(data, offsets, share, number)
        p = Phrases(data, offsets, langs, longest)
        found = [p.key[1]] if last is None else []
        if bits is None:
            found += [p.key[k][p.whole[k]] for k in range(2, longest + 1)]
        else:
            held = {k: may_hold(bits, p.key[k]) for k in range(1, longest)}
            old = {k: may_hold(last, p.key[k]) for k in range(1, longest)} if last is not None else None
            for k in range(2, longest + 1):
                own = p.candidates(k, held)
                if old is not None:
                    own &= ~p.candidates(k, old)
                found.append(p.key[k][own])
        keys, counts = summed(np.concatenate(found))
        if len(keys):
            yield sent(int(chunk.view(np.int64)), keys, counts, buckets)


@tidy
def _spelled(batches: Iterator[pa.RecordBatch], longest: int, bits: bytes, places: tuple[bytes, bytes] | None) -> Iterator[pa.RecordBatch]:
    """(key, lang, k, phrase) of the phrases that the table may hold, each once a chunk; with ``places``, only in a chunk that may be its place."""
    for data, offsets, langs in _texts(batches):
        chunk = np.array([_name(data, offsets, langs)], _U)
        p = Phrases(data, offsets, langs, longest)
        w = p.words
        ends = np.append(w.begin, len(w.letters)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(w.letters))]) if len(w.begin) else pa.array([], pa.large_binary())
        for k in range(1, longest + 1):
            at = np.flatnonzero(p.whole[k])
            at = at[may_hold(bits, p.key[k][at])]
            if places is not None:
                here = place(p.key[k][at], chunk)
                at = at[may_hold(places[0], here) & may_hold(places[1], here << _U(32))]
            keys, one = np.unique(p.key[k][at], return_index=True)
            at = at[one]
            if len(at):
                parts = [words.take(pa.array(at + j)) for j in range(k)]
                phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
                lang = pa.array(langs, pa.string()).take(pa.array(w.doc[at]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), lang, pa.array(np.full(len(at), k, np.int32)), phrase.cast(pa.large_string()).cast(pa.string())], ["key", "lang", "k", "phrase"])


def _spell(rows: DataFrame, every: DataFrame, longest: int, placed: bool) -> DataFrame:
    """(key, lang, k, phrase) of all keys of ``every`` and of some others, each once."""
    exact, places = bit_table(every, "key", TABLE_BITS), None
    if placed:
        bits = min(MOST_BITS, max(TABLE_BITS, (PLACE_BITS * every.count()).bit_length()))
        places = bit_table(every, "place", bits), bit_table(every.withColumn("low", F.shiftleft("place", 32)), "low", bits)
    spelled = rows.mapInArrow(lambda it: _spelled(it, longest, exact, places), "key long, lang string, k int, phrase string")
    return spelled.groupBy("key").agg(F.first("lang").alias("lang"), F.first("k").alias("k"), F.first("phrase").alias("phrase"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, share: float = SHARE, lowered: float = LOWERED) -> DataFrame:
    """(lang, k, phrase, f, n): every phrase of 1 to ``longest`` words that occurs ``least`` times or more in its language.

    Occurrences are counted exactly, overlapping ones too, within pieces; n counts
    the language's words. Words are joined by one space. A null text is empty, a
    null language ``und``; rows that repeat are counted each; other columns are
    ignored; an empty table has no phrases. A text is cut at the ends of pieces, and
    only an unbroken piece is handled whole.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), F.col(text_col).alias("_text"))
    # a batch goes to Python whole; texts of a hundred kilobytes come two thousand at once at most
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).collect()[0][0]
    buckets = max(1, -(-int(size) // BUCKET_BYTES))

    def counts(bits: bytes | None, last: bytes | None = None, at_least: int = least) -> DataFrame:
        return frequent(rows.mapInArrow(lambda it: _counted(it, longest, buckets, bits, last, share), SENT), at_least)

    proposed = scratch.save(counts(None, at_least=max(1, int(least * share * lowered))).select("key"))
    bits = bit_table(proposed, "key", TABLE_BITS)
    found = scratch.save(counts(bits))
    every = found
    while True:
        wider = _either(bits, bit_table(found, "key", TABLE_BITS))
        if wider == bits:  # whatever is frequent had been proposed: the border holds
            break
        found = scratch.save(counts(wider, bits))
        every, bits = every.unionByName(found), wider
        if found.isEmpty():
            break
    every = scratch.save(every)  # one table: a join with a union would read the texts once for each of its parts
    names = scratch.save(_spell(rows, every, longest, True))
    rest = every.join(names, "key", "left_anti").select("key")
    if not rest.isEmpty():  # texts came in other chunks than they were counted in
        rest = scratch.save(rest)
        names = names.unionByName(_spell(rows, rest, longest, False).join(rest, "key", "left_semi"))
    totals = rows.mapInArrow(_totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    return scratch.save(names.join(every.select("key", F.col("n").alias("f")), "key").join(totals, "lang").select("lang", "k", "phrase", "f", "n"))


@tidy
def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each language, a row for each chunk."""
    for data, offsets, langs in _texts(batches):
        begins = WORD_BYTES[data]
        inside = begins.copy()
        inside[1:] &= begins[:-1]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        inside[edge] = False
        before = np.append(0, np.cumsum(begins & ~inside))
        n = before[offsets[1:]] - before[offsets[:-1]]
        own = {}
        for lang, m in zip(langs, n.tolist(), strict=True):
            own[lang] = own.get(lang, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "n"])


def _either(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = 100, share: float = SHARE, lowered: float = LOWERED) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate is a frequent phrase of 2 to ``longest`` words. Of its cuts in two
    the one with the least score counts, floor(1000 * a * n / (l * r)), of equals the
    first. A candidate goes if one that is a word longer, dropped or not, holds it and
    has ``percent`` of its occurrences or more; a still longer one has no more. Order:
    score and a falling, then the phrase by its UTF-8 bytes.
    """
    spark = docs.sparkSession
    every = frequent_phrases(docs, text_col, lang_col, least, longest, share, lowered)
    f = every.select("lang", "phrase", "f")
    longer = every.where("k >= 3").withColumn("w", F.split("phrase", " "))
    parts = F.explode(F.array(F.expr("array_join(slice(w, 1, k - 1), ' ')"), F.expr("array_join(slice(w, 2, k - 1), ' ')"))).alias("phrase")
    inside = longer.select("lang", parts, "f").groupBy("lang", "phrase").agg(F.max("f").alias("more"))
    kept = every.where("k >= 2").join(inside, ["lang", "phrase"], "left").where(f"more is null or 100 * more < {percent} * f")
    cut = kept.withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "n", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("one"), F.expr("array_join(slice(w, cut + 1, k - cut), ' ')").alias("two"))
    cut = cut.join(f.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l")), ["lang", "one"]).join(f.select("lang", F.col("phrase").alias("two"), F.col("f").alias("r")), ["lang", "two"])
    whole = "cast(1000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))"
    # the remainder is taken away first, so that the quotient is a whole number and no digit is rounded
    cut = cut.withColumn("x", F.expr(f"cast({whole} as decimal(38,0))")).withColumn("y", F.expr("cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))"))
    cut = cut.withColumn("score", F.expr("cast((x - x % y) / y as decimal(38,0))").cast("long"))
    best = cut.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases are ranked in parts first, of which no more than the first can be among the first
    part = F.pmod(F.xxhash64("phrase"), F.lit(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    few = best.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
