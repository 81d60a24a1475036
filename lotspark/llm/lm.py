"""Trigram language model: counts exchanged once per chunk of text, quantised probabilities in Elias-Fano tries.

Smoothing is MacKay and Peto's hierarchical Dirichlet ("A hierarchical Dirichlet
language model", 1995): p(w | u v) = (c(u v w) + b p(w | v)) / (c(u v) + b), p(w | v)
alike with a, and p(w) = (c(w) + 1) / (N + V + 1). It needs plain counts only, which
add up wherever they come from, so no word or pair is one task's.

1. Texts become chunks of word numbers, and each chunk's distinct words are counted
   and numbered (``gram_counts``).
2. A chunk sends its distinct trigrams, with their counts in the texts to learn from,
   to tries that are dealt by the middle word. Trigrams around a word too frequent for
   one task go to several tries, by their other words, with that word's counts of pairs.
3. A task builds its trie in one memory map, looks up all trigrams that came and sends
   their logarithms back to the chunks, which add them up by text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .gram_counts import SENT, received, sent, summed
from .ngram_trie import STEPS, Ranges, Rising, Trie, code, value
from .scratch import Scratch
from .text_arrays import SPACE_SPLIT, Words, cut_chunks, mix, small_batches, tidy, tidy_group

_U = np.uint64
#: Words that a context's shorter one counts for: a of pairs, b of trigrams.
PAIR_WEIGHT, TRIPLE_WEIGHT = 1000.0, 5.0
CHUNK = 4 << 20
#: Tokens of the corpus for each trie, and occurrences of a middle word beyond which it has tries of its own.
TRIE_TOKENS, HOT = 250_000, 3_000_000
#: Words for each task that numbers them.
BUCKET_TOKENS = 2_000_000
END, START = 0, 1
FIXED = 2.0**40


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers by planes of their bytes, compressed; many are small or close to each other."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) < 1 << 8 * w)
    planes = np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n).astype(np.int64)


def _row(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([columns[c]], t) for c, t in types.items()], list(types))


# --- 1. chunks ------------------------------------------------------------------------------------
def _chunk_types(kind: pa.DataType) -> dict[str, pa.DataType]:
    return {
        "chunk": pa.int64(), "owner": pa.int64(), "ids": pa.list_(kind), "learn": pa.list_(pa.bool_()), "closes": pa.bool_(), "lens": pa.binary(), "tokens": pa.binary(),
        "carry": pa.list_(pa.int64()), "n_tokens": pa.int64(), "n_learnt": pa.int64(), "ends": pa.int64(), "words": pa.binary(), "counts": pa.binary(),
    }


@tidy
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, learn, text) into chunks.

    ``tokens`` are places in the chunk's sorted words; the end is one more than the
    last, the start two more. A text that is cut goes on with ``carry``, its last two
    words, and belongs to the ``owner`` chunk in which it began.
    """
    for batch in batches:
        types = _chunk_types(batch.schema.field(0).type)
        owner, before = 0, None
        for rows, data, offsets, opens, closes in cut_chunks(batch, "_text", ~SPACE_SPLIT, CHUNK):
            words = Words(data, offsets, SPACE_SPLIT)
            ids, learn = (batch.column(i).slice(rows.start, rows.stop - rows.start).to_pylist() for i in (0, 1))
            chunk = int.from_bytes(os.urandom(8), "little") >> 1
            owner = chunk if opens else owner
            carried = before if not opens and before is not None else np.zeros(0, _U)
            distinct, at = np.unique(np.append(words.hash, carried), return_inverse=True)
            size = len(distinct)
            own, last = at[: len(words.hash)], at[len(words.hash) :].tolist()
            learnt = np.array(learn, bool)
            counts = np.bincount(own, learnt[words.doc] if len(own) else None, size).astype(np.int64)
            lens = words.count + (1 if closes else 0)
            tokens = np.full(int(lens.sum()), size)
            tokens[np.arange(len(own)) + (words.doc if closes else 0)] = own
            carry = ([size + 1, size + 1] + last)[-2:] if not opens else [size + 1, size + 1]
            if not closes:
                kept = np.append(carried, words.hash)[-2:]
                before = kept
            yield _row(
                {
                    "chunk": chunk, "owner": owner, "ids": ids, "learn": learn, "closes": closes, "lens": packed(lens), "tokens": packed(tokens), "carry": carry,
                    "n_tokens": len(tokens), "n_learnt": int(lens[learnt].sum()), "ends": int(learnt.sum()) if closes else 0, "words": distinct.tobytes(), "counts": packed(counts),
                },
                types,
            )


@tidy
def _words_sent(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if words:
                yield sent(chunk, np.frombuffer(words, _U), unpacked(counts), buckets)


def _numbered(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Each chunk's words of a bucket get their numbers, small ones for frequent words, and counts."""

    @tidy_group
    def task(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        keys, counts, lens = received(group)
        distinct, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, counts, len(distinct)).astype(np.int64)
        rank = np.empty(len(distinct), np.int64)
        rank[np.lexsort((distinct, -total))] = np.arange(len(distinct))
        number = rank * buckets + bucket + 2
        ends = np.cumsum(lens)
        cut = lambda a: [packed(a[at[e - n : e]]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
        # known: words of the training texts, told once a bucket
        known = [int((total > 0).sum())] + [0] * (len(lens) - 1)
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "numbers": cut(number), "totals": cut(total), "known": known})

    return task


@tidy_group
def _joined(chunk: pa.Table, replies: pa.Table) -> pa.Table:
    """A chunk with the numbers and totals of its words."""
    if not chunk.num_rows:
        raise ValueError("a reply without its chunk")
    replies = replies.sort_by("bucket")
    whole = lambda c: packed(np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for x in replies.column(c).to_pylist())]))
    return chunk.append_column("numbers", pa.array([whole("numbers")], pa.binary())).append_column("totals", pa.array([whole("totals")], pa.binary()))


# --- 2. trigrams ----------------------------------------------------------------------------------
class _Grams:
    """Distinct trigrams of a chunk: ``v``, ``w``, ``u`` as word numbers, places ``v_at`` and so on among the words, ``n`` in texts to learn from, ``back`` of each token."""

    def __init__(self, row: dict):
        self.lens, tokens = unpacked(row["lens"]), unpacked(row["tokens"])
        numbers = unpacked(row["numbers"])
        size = len(numbers)
        self.number = np.concatenate([numbers, [END, START]])
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        first = np.cumsum(self.lens) - self.lens
        first = first[self.lens > 0]
        one, two = np.full(len(tokens), size + 1), np.full(len(tokens), size + 1)
        one[1:], two[2:] = tokens[:-1], tokens[:-2]
        one[first], two[first] = size + 1, size + 1
        two[first[self.lens[self.lens > 0] > 1] + 1] = size + 1
        if len(tokens):  # of a text that goes on
            one[0], two[0] = row["carry"][1], row["carry"][0]
            if self.lens[0] > 1:
                two[1] = row["carry"][1]
        bits = (size + 2).bit_length()
        if 3 * bits <= 63:
            key, self.back = np.unique((one << bits | tokens) << bits | two, return_inverse=True)
            rest = key >> bits
        else:
            pair, at = np.unique(one << bits | tokens, return_inverse=True)
            key, self.back = np.unique(at << bits | two, return_inverse=True)
            rest = pair[key >> bits]
        mask = (1 << bits) - 1
        self.v_at, self.w_at, self.u_at = rest >> bits, rest & mask, key & mask
        self.v, self.w, self.u = self.number[self.v_at], self.number[self.w_at], self.number[self.u_at]
        learnt = np.array(row["learn"], bool)[self.doc] if len(tokens) else np.zeros(0, bool)
        self.n = np.bincount(self.back, learnt, len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        self.tokens = tokens

    def totals(self, row: dict, ends: int) -> np.ndarray:
        """Occurrences of each of the chunk's words in the texts to learn from; of the start as often as of the end."""
        return np.concatenate([unpacked(row["totals"]), [ends, ends]])

    def trie(self, hot: np.ndarray, tries: int, totals: np.ndarray, limit: int) -> np.ndarray:
        """Number of the trie of each trigram; those of hot middle words are negative and have one middle word each."""
        own = (mix(self.v.astype(_U)) % _U(tries)).astype(np.int64)
        if hot.any():
            parts = -(-totals[self.v_at[hot]] // limit)
            part = (mix(self.u[hot].astype(_U) * _U(0x9E3779B97F4A7C15) ^ self.w[hot].astype(_U)) % parts.astype(_U)).astype(np.int64)
            own[hot] = -1 - (mix(mix(self.v[hot].astype(_U)) + part.astype(_U)) >> _U(2)).astype(np.int64)
        return own

    def pairs(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of trigrams with hot middle words: keys of (v, w) and of (u, v)."""
        return pair_key(self.v[hot], self.w[hot]), pair_key(self.u[hot], self.v[hot])


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.astype(_U)) * _U(3) + b.astype(_U))


def _hot(grams: _Grams, totals: np.ndarray, limit: int) -> np.ndarray:
    return totals[grams.v_at] > limit


def _pair_counts(g: _Grams, totals: np.ndarray, hot: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's pairs that hot middle words need, as rising keys, and how often each stands in its texts to learn from."""
    frequent = totals > limit
    own = frequent[g.v_at] | frequent[g.w_at]
    # each token stands for the pair that ends in it; two starts stand before each text
    starts = hot & (g.v == START) & (g.u == START)
    found, asked = np.append(pair_key(g.v[own], g.w[own]), pair_key(g.u[starts], g.v[starts])), np.append(*g.pairs(hot))
    return summed(np.append(found, asked), np.concatenate([g.n[own], g.n[starts], np.zeros(len(asked), np.int64)]))


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}


@tidy
def _pairs_sent(batches: Iterator[pa.RecordBatch], buckets: int, ends: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs in trigrams with hot middle words, as often as they stand in texts to learn from."""
    for row in _dicts(batches):
        g = _Grams(row)
        totals = g.totals(row, ends)
        hot = _hot(g, totals, limit)
        if not hot.any():
            continue
        yield sent(row["chunk"], *_pair_counts(g, totals, hot, limit), buckets)


@tidy_group
def _pairs_counted(group: pa.Table) -> pa.Table:
    keys, counts, lens = received(group)
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, counts, len(distinct)).astype(np.int64)[at]
    ends = np.cumsum(lens)
    return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "pair_totals": [packed(total[e - n : e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]})


@tidy_group
def _with_pairs(chunk: pa.Table, replies: pa.Table) -> pa.Table:
    """A chunk with the counts of its pairs, in the order of their keys, which it works out again."""
    replies = replies.sort_by("bucket")
    totals = packed(np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for x in replies.column("pair_totals").to_pylist())]))
    return chunk.append_column("pair_totals", pa.array([totals], pa.binary()))


GRAMS = "trie long, chunk long, grams array<binary>"


@tidy
def _grams_sent(batches: Iterator[pa.RecordBatch], tries: int, ends: int, whole: float, limit: int) -> Iterator[pa.RecordBatch]:
    for row in _dicts(batches):
        g = _Grams(row)
        totals = g.totals(row, ends)
        hot = _hot(g, totals, limit)
        at = g.trie(hot, tries, totals, limit)
        order = np.argsort(at, kind="stable")
        used, low = np.unique(at[order], return_index=True)
        one = code(np.log10((totals + 1) / whole))[g.w_at].astype(np.int64)
        columns = [x[order] for x in (g.v, g.w, g.u, g.n, one)]
        if hot.any():
            vw, uv = g.pairs(hot)
            keys, counts = _pair_counts(g, totals, hot, limit)[0], unpacked(row["pair_totals"])
            more = np.zeros((3, len(at)), np.int64)
            more[0, hot], more[1, hot], more[2, hot] = totals[g.v_at[hot]], counts[np.searchsorted(keys, vw)], counts[np.searchsorted(keys, uv)]
            more = more[:, order]
        blobs = []
        for t, i, j in zip(used.tolist(), low.tolist(), [*low[1:].tolist(), len(at)], strict=True):
            blobs.append([packed(c[i:j]) for c in [*columns, *(more if t < 0 else ())]])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(np.full(len(used), row["chunk"]), pa.int64()), pa.array(blobs, pa.list_(pa.binary()))], ["trie", "chunk", "grams"])


# --- 3. tries -------------------------------------------------------------------------------------
def _runs(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: where each begins, the sum of its n, and which run each row is in."""
    edge = np.append(True, key[1:] != key[:-1])
    begin = np.flatnonzero(edge)
    return begin, np.add.reduceat(n, begin), np.cumsum(edge) - 1


def build(v: np.ndarray, w: np.ndarray, u: np.ndarray, n: np.ndarray, one: np.ndarray, a: float, b: float, counts: list[np.ndarray] | None = None) -> Trie:
    """Trie of trigrams u v w that occur n > 0 times, distinct and sorted by v, w, u; ``one`` is the code of each w by itself.

    ``counts`` has c(v), c(v w) and c(u v) of each, where not all of v's trigrams are here.
    """
    begin_v, c_v, of_v = _runs(v, n)
    pair = np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]))
    begin_p = np.flatnonzero(pair)
    of_p = np.cumsum(pair) - 1
    c_p = np.add.reduceat(n, begin_p)
    order = np.lexsort((u, v))
    edge = np.append(True, (v[order][1:] != v[order][:-1]) | (u[order][1:] != u[order][:-1]))
    begin_c = np.flatnonzero(edge)
    c_c = np.add.reduceat(n[order], begin_c)
    if counts:
        c_v, c_p, c_c = counts[0][begin_v], counts[1][begin_p], counts[2][order][begin_c]
    two = code(np.log10((c_p + a * value(one[begin_p])) / (c_v[of_v[begin_p]] + a)))
    # a follower's number under u v is its place among the followers of v
    first_p = of_p[begin_v]
    relative = of_p - first_p[of_v]
    of_c = np.empty(len(v), np.int64)
    of_c[order] = np.cumsum(edge) - 1
    by_c = np.lexsort((relative, of_c))
    three = code(np.log10((n + b * value(two[of_p])) / (c_c[of_c] + b)))[by_c]
    return Trie(
        Rising.build(v[begin_v]), code(np.log10(a / (c_v + a))), Ranges.build(of_v[begin_p], w[begin_p], len(begin_v)), two,
        Ranges.build(of_v[order][begin_c], u[order][begin_c], len(begin_v)), code(np.log10(b / (c_c + b))), Ranges.build(of_c[by_c], relative[by_c], len(begin_c)), three,
    )


def answered(columns: list[np.ndarray], a: float, b: float) -> np.ndarray:
    """Steps of each row's logarithm: the rows of training texts make the trie in which all are looked up."""
    v, w, u, n, one = columns[:5]
    first, at = np.unique(v, return_inverse=True)
    bits = [int(x.max()).bit_length() for x in (w, u)]
    if len(first).bit_length() + sum(bits) <= 63:
        _, where, back = np.unique((at << bits[0] | w) << bits[1] | u, return_index=True, return_inverse=True)
    else:
        _, where, back = np.unique(np.stack([v, w, u]), axis=1, return_index=True, return_inverse=True)
    total = np.bincount(back, n, len(where)).astype(np.int64)
    v, w, u, one = v[where], w[where], u[where], one[where]
    seen = total > 0
    counts = [c[where] for c in columns[5:]]
    steps, third = one, np.zeros(len(v), bool)
    if seen.any():  # else there is nothing to learn from here
        trie = Trie.read(build(v[seen], w[seen], u[seen], total[seen], one[seen], a, b, [c[seen] for c in counts]).write())
        steps, third = trie.score(u, v, w, one)
    if counts:
        # pairs of a hot word may have been learnt in another of its tries: the counts that came with the rows say it
        c_v, c_p, c_c = counts
        two = np.where(c_p > 0, code(np.log10((c_p + a * value(one)) / (c_v + a))), one + code(np.log10(a / (c_v + a))).astype(np.int64))
        steps = np.where(third, steps, two + code(np.log10(b / (c_c + b))))
    return steps[back]


def _answers(a: float, b: float) -> Callable[[pa.Table], pa.Table]:
    @tidy_group
    def task(group: pa.Table) -> pa.Table:
        rows = [[unpacked(x) for x in blobs] for blobs in group.column("grams").to_pylist()]
        lens = [len(r[0]) for r in rows]
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
        del rows
        steps = answered(columns, a, b)
        ends = np.cumsum(lens)
        return pa.table({"trie": group.column("trie"), "chunk": group.column("chunk"), "steps": [packed(steps[e - n : e]) for e, n in zip(ends.tolist(), lens, strict=True)]})

    return task


def _added(tries: int, ends: int, whole: float, limit: int, kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A chunk's texts with their sums."""

    @tidy_group
    def task(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        row = {c: chunk.column(c)[0].as_py() for c in chunk.schema.names}
        g = _Grams(row)
        totals = g.totals(row, ends)
        order = np.argsort(g.trie(_hot(g, totals, limit), tries, totals, limit), kind="stable")
        replies = replies.sort_by("trie")
        steps = np.empty(len(g.v), np.int64)
        steps[order] = np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for x in replies.column("steps").to_pylist())])
        n = len(g.lens)
        by_doc = lambda x: np.bincount(g.doc, x, n) if len(g.doc) else np.zeros(n)
        alone = np.rint(np.log10((totals + 1) / whole) * FIXED)[g.tokens] if len(g.tokens) else np.zeros(0)
        base = np.zeros(n, np.int64)
        np.add.at(base, g.doc, alone.astype(np.int64))
        return pa.table(
            {
                "owner": pa.array(np.full(n, row["owner"])), "row": pa.array(np.arange(n)), "_id": pa.array(row["ids"], kind), "learn": pa.array(row["learn"]),
                "n_tokens": pa.array(g.lens), "n_known": pa.array(by_doc(totals[g.tokens] > 0).astype(np.int64)), "base": pa.array(base), "steps": pa.array(by_doc(steps[g.back]).astype(np.int64)),
            }
        )

    return task


def score_texts(
    docs: DataFrame, learn_col: str, id_col: str = "doc_id", text_col: str = "text", pair_weight: float = PAIR_WEIGHT, triple_weight: float = TRIPLE_WEIGHT,
    trie_tokens: int = TRIE_TOKENS, hot: int = HOT,
) -> DataFrame:
    """Per row of ``docs``: id, learnt, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows whose boolean ``learn_col`` is true and scores all.
    Tokens are the words between white space, A-Z in lower case, then one end.
    n_known counts tokens that occur in training texts, base_score is the log10
    probability by single words, score that of the model, whose steps are 1 / 1,024.
    A null or empty text is its end alone; a null ``learn_col`` is false; rows that
    repeat an id stay rows; other columns are ignored; an empty table stays empty.
    Without texts to learn from all tokens are unknown. A text is cut at white space,
    so only an unbroken run is handled whole; a task holds one chunk of ``CHUNK``
    bytes or about ``trie_tokens`` distinct trigrams, at most ``hot`` of one middle word.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lm", keep_shuffles=False)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(learn_col), F.lit(False)).alias("_learn"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    texts = f"chunk long, owner long, ids array<{kind}>, learn array<boolean>, closes boolean, lens binary, tokens binary, carry array<long>"
    chunks = scratch.save(rows.mapInArrow(_chunks, f"{texts}, n_tokens long, n_learnt long, ends long, words binary, counts binary"))
    tokens, learnt, ends = (int(x or 0) for x in chunks.agg(F.sum("n_tokens"), F.sum("n_learnt"), F.sum("ends")).collect()[0])
    buckets, tries = max(1, -(-tokens // BUCKET_TOKENS)), max(1, -(-tokens // trie_tokens))
    asked = chunks.select("chunk", "words", "counts").mapInArrow(lambda it: _words_sent(it, buckets), SENT)
    numbers = scratch.save(asked.groupBy("bucket").applyInArrow(_numbered(buckets), "chunk long, bucket long, numbers binary, totals binary, known long"))
    known = int(numbers.agg(F.sum("known")).collect()[0][0] or 0) + (ends > 0)
    whole = float(learnt + known + 1)
    slim = chunks.drop("n_tokens", "n_learnt", "ends", "words", "counts")
    schema = f"{texts}, numbers binary, totals binary"
    full = scratch.save(slim.groupBy("chunk").cogroup(numbers.drop("known").groupBy("chunk")).applyInArrow(_joined, schema))
    scratch.drop(chunks, numbers)
    asking = full
    if ends > hot or _any_hot(full, hot):
        pairs = full.mapInArrow(lambda it: _pairs_sent(it, buckets, ends, hot), SENT).groupBy("bucket").applyInArrow(_pairs_counted, "chunk long, bucket long, pair_totals binary")
        asking = scratch.save(full.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(_with_pairs, f"{schema}, pair_totals binary"))
        scratch.drop(full)
        full = asking.drop("pair_totals")
    grams = asking.mapInArrow(lambda it: _grams_sent(it, tries, ends, whole, hot), GRAMS)
    steps = scratch.save(grams.groupBy("trie").applyInArrow(_answers(pair_weight, triple_weight), "trie long, chunk long, steps binary"))
    added = _added(tries, ends, whole, hot, to_arrow_type(rows.schema["_id"].dataType))
    parts = full.groupBy("chunk").cogroup(steps.groupBy("chunk")).applyInArrow(added, f"owner long, row long, _id {kind}, learn boolean, n_tokens long, n_known long, base long, steps long")
    per = parts.groupBy("owner", "row").agg(F.first("_id").alias(id_col), F.first("learn").alias("learnt"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "steps")))
    return per.select(id_col, "learnt", "n_tokens", "n_known", F.lit(learnt).cast("long").alias("train_tokens"), (F.col("base") / FIXED).alias("base_score"), (-F.col("steps") / float(STEPS)).alias("score"))


def _any_hot(full: DataFrame, hot: int) -> bool:
    """Is any word of the corpus too frequent for one trie?"""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max((int(unpacked(x).max(initial=0)) for x in batch.column(0).to_pylist()), default=0)], pa.int64())], ["most"])

    return (full.select("totals").mapInArrow(largest, "most long").agg(F.max("most")).collect()[0][0] or 0) > hot
