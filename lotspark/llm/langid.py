"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of the letter.
An n-gram's vector is the product of its letters' vectors, the letter at place j
rotated by j; a text's vector is the sum over its n-grams, a language's
prototype that over its texts (Joshi, Halseth & Kanerva, "Language geometry
using random indexing", 2016). A text gets the language whose prototype has the
largest cosine with it.

Training bundles per task and sums per language in Spark; the model is
``languages x dims`` numbers, whatever the corpus' size.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import mix, small_batches, text_chunks, tidy

DIMS, GRAM = 1024, 3
#: Bytes of texts that are handled at once, of a piece of a longer text, and n-grams whose vectors are in memory.
CHUNK, PIECE_BYTES, GRAMS = 1 << 19, 1 << 20, 4096
_U = np.uint64


@lru_cache(1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: the lower-case letter that stands for it (0: no letter), and whether it is a letter."""
    fold, letter = np.zeros(0x110000, np.int32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            letter[c], fold[c] = True, ord(low) if len(low) == 1 else c
    return fold, letter


@lru_cache(1 << 12)
def _letter(code: int, dims: int) -> np.ndarray:
    bits = mix(np.arange(dims, dtype=_U) + np.array([code + 1], _U) * _U(0x9E3779B97F4A7C15)) >> _U(63)
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


def _vectors(keys: np.ndarray, gram: int, dims: int) -> np.ndarray:
    """One row per n-gram, given as letters of 21 bits each; 0 is the gap between words."""
    grams = np.stack([keys >> 21 * (gram - 1 - j) & 0x1FFFFF for j in range(gram)], axis=1)
    codes, place = np.unique(grams, return_inverse=True)
    place = place.reshape(grams.shape)
    letters = np.stack([_letter(int(c), dims) for c in codes])
    out = np.ones((len(grams), dims), np.int8)
    for j in range(gram):
        out *= np.roll(letters, j, axis=1)[place[:, j]]
    return out


def _codes(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int32)


def _grams(data: np.ndarray, offsets: np.ndarray, gram: int, carry: np.ndarray | None = None, closes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a chunk; row, n-gram and count of each pair that occurs; rows with a letter; the last letters.

    Runs of other characters count as one gap, as do a text's ends. N-grams stay
    within a row. ``carry`` has the last letters of the piece before, if the chunk is
    a later piece of one text, which ``closes`` or goes on.
    """
    fold, letter = _fold()
    n = len(offsets) - 1
    first = (data & 0xC0) != 0x80
    row = np.repeat(np.arange(n, dtype=np.int32), np.add.reduceat(np.append(first, False), offsets[:-1]) * (np.diff(offsets) > 0) if n else 0)
    codes = _codes(data)
    has = np.bincount(row, letter[codes], n) > 0
    codes = fold[codes]
    if carry is not None:
        codes, row = np.append(carry, codes), np.zeros(len(carry) + len(codes), np.int32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (row[1:] != row[:-1])
    codes, row = codes[keep], row[keep]
    # a gap before and after each text, so that one letter makes an n-gram of three
    some = np.unique(row)
    for side in (["left"] if carry is None else []) + (["right"] if closes else []):
        at = np.searchsorted(row, some, side)
        edge = codes[at if side == "left" else at - 1] != 0
        codes, row = np.insert(codes, at[edge], 0), np.insert(row, at[edge], some[edge])
    size = max(0, len(codes) - gram + 1)
    whole = row[:size] == row[gram - 1 :] if size else np.zeros(0, bool)
    key = np.zeros(size, np.int64)
    for j in range(gram):
        key = key << 21 | codes[j : size + j]
    distinct, at = np.unique(key[whole], return_inverse=True)
    pair, count = np.unique(row[:size][whole] * max(1, len(distinct)) + at, return_counts=True)
    return distinct, pair // max(1, len(distinct)), pair % max(1, len(distinct)), count, has, codes[max(0, len(codes) - gram + 1) :]


def _sums(data: np.ndarray, offsets: np.ndarray, gram: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundle of each row of a chunk, and rows with a letter. A long text goes piece by piece, vectors ``GRAMS`` at a time."""
    n = len(offsets) - 1
    out, has = np.zeros((n, dims)), np.zeros(n, bool)
    at, carry = 0, None
    while at < len(data):
        end = len(data)
        if n == 1 and end - at > PIECE_BYTES:
            end = at + PIECE_BYTES
            while data[end] & 0xC0 == 0x80:  # within a character
                end -= 1
        own = offsets if n > 1 else np.array([0, end - at])
        keys, row, of, count, some, carry = _grams(data[at:end], own, gram, carry, end == len(data))
        has |= some
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(0, len(keys) + GRAMS, GRAMS))
        for i, low in enumerate(range(0, len(keys), GRAMS)):
            vectors = _vectors(keys[low : low + GRAMS], gram, dims).astype(np.float32)
            part = order[edges[i] : edges[i + 1]]
            rows, back = np.unique(row[part], return_inverse=True)
            for first in range(0, len(rows), 256):
                mine = (back >= first) & (back < first + 256)
                counts = np.zeros((min(256, len(rows) - first), len(vectors)), np.float32)
                counts[back[mine] - first, of[part[mine]] - low] = count[part[mine]]
                out[rows[first : first + 256]] += counts @ vectors
        at = end
    return out, has


@tidy
def _bundle(batches: Iterator[pa.RecordBatch], gram: int, dims: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0)
        for rows, data, offsets in text_chunks(batch, "_text", CHUNK):
            names = np.array(langs.slice(rows.start, rows.stop - rows.start).to_pylist(), object)
            for lang in sorted(set(names.tolist())):  # a language's texts count as one row
                mine = np.flatnonzero(names == lang)
                if len(mine) == len(names) == 1:
                    total = _sums(data, offsets, gram, dims)[0][0]
                else:
                    total = _language_sum(data, offsets, mine, gram, dims)
                sums[lang] = sums.get(lang, np.zeros(dims)) + total
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([np.rint(v).astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))], ["lang", "bundle"]
    )


def _language_sum(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, gram: int, dims: int) -> np.ndarray:
    """Bundle of some rows of a chunk together."""
    keys, row, of, count, _, _ = _grams(data, offsets, gram)
    own = np.isin(row, rows)
    counts = np.bincount(of[own], count[own], len(keys)).astype(np.float32)
    out = np.zeros(dims)
    for low in range(0, len(keys), GRAMS):
        part = counts[low : low + GRAMS]
        if part.any():
            out += part @ _vectors(keys[low : low + GRAMS], gram, dims).astype(np.float32)
    return out


def train_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", gram: int = GRAM, dims: int = DIMS) -> dict[str, list[int]]:
    """Prototype of each non-null language of ``docs``; bounded by languages x dims."""
    small_batches(docs.sparkSession)
    some = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    parts = some.mapInArrow(lambda it: _bundle(it, gram, dims), "lang string, bundle array<long>")
    sums = parts.select("lang", F.posexplode("bundle").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).getField("v").alias("bundle")).collect()
    return {r.lang: list(r.bundle) for r in sorted(rows, key=lambda r: r.lang)}


@tidy
def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold, _ = _fold()
    total = np.zeros(0x110000, np.int64)
    for batch in batches:
        for _, data, _ in text_chunks(batch, "_text", CHUNK):
            for at in range(0, len(data), PIECE_BYTES):  # a cut character is none
                total += np.bincount(fold[_codes(data[at : at + PIECE_BYTES])], minlength=0x110000)
    total[[0, 0xFFFD]] = 0
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["code", "n"])


def train_alphabet(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = 1e-5) -> str:
    """Lower-case letters that make up ``share`` or more of the letters of texts with a language; at most ``1 / share``."""
    small_batches(docs.sparkSession)
    some = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("_text"))
    counts = some.mapInArrow(_letters, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return "".join(chr(r[0]) for r in counts.where(F.col("n") >= share * total).select("code").orderBy("code").collect())


@tidy
def _predict(batches: Iterator[pa.RecordBatch], model: dict[str, list[int]], gram: int, dims: int) -> Iterator[pa.RecordBatch]:
    names = list(model)
    protos = np.array([model[x] for x in names], np.float64).reshape(len(names), dims)
    norms = np.linalg.norm(protos, axis=1, keepdims=True)
    protos = (protos / np.where(norms > 0, norms, 1)).astype(np.float32)
    for batch in batches:
        keys = batch.columns[:-1]
        for rows, data, offsets in text_chunks(batch, "_text", CHUNK):
            n = rows.stop - rows.start
            own, has = _sums(data, offsets, gram, dims)
            size = np.linalg.norm(own, axis=1, keepdims=True)
            cosines = (own.astype(np.float32) @ protos.T) / np.where(size > 0, size, 1) if names else np.zeros((n, 1))
            best = cosines.argmax(axis=1)
            known = has & bool(names)
            score = np.where(known, np.clip(np.round(cosines[np.arange(n), best], 6), 0, 1), 0.0)
            lang = [names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(k.slice(rows.start, n) for k in keys), pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names[:-1], "lang_pred", "score"])


def identify_language(docs: DataFrame, model: dict[str, list[int]], text_col: str = "text", gram: int = GRAM, dims: int = DIMS) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score, the cosine with the best prototype, cut to 0..1.

    Null texts and texts without a letter get ``und`` and 0, as do all if the
    model knows no language. Ties go to the first language by name. A long text is
    read in pieces, none of its n-grams is lost. A column that is already named lang_pred, score or _text is
    replaced.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "_text")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "lang_pred string", "score double"])
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).alias("_text"))
    return rows.mapInArrow(lambda it: _predict(it, model, gram, dims), schema)
