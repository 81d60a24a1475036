"""Columns of text as numpy arrays: words, word hashes and rolling k-grams.

Spark deals the rows; these helpers see one Arrow batch at a time, a bounded
number of bytes of it at once, and never look beyond it. Hashes are functions
of the bytes alone, so every executor computes the same ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows that go to Python at once. Both sides hold a batch outside of Spark's memory, and texts are large rows.
BATCH_ROWS = 2000
CHUNK_BYTES = 1 << 20
_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)
_GRAM = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _FACTOR)


def byte_class(dropped: str) -> np.ndarray:
    """Table of 256 booleans: may this UTF-8 byte stand in a word?"""
    table = np.ones(256, bool)
    table[[ord(c) for c in dropped]] = False
    return table


SPACE_SPLIT = byte_class(" \t\n\x0b\x0c\r")
ALNUM_SPLIT = byte_class("".join(chr(b) for b in range(128) if not chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows in this session, unless the caller has set a number of their own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system; else a worker keeps it for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        pass


def tidy(task: Callable) -> Callable:
    """A function over batches that gives memory back at its end, as later stages use the same worker."""

    @wraps(task)
    def run(*args, **kwargs):
        yield from task(*args, **kwargs)
        give_back()

    return run


def tidy_group(task: Callable) -> Callable:
    """A function of a group's table, or of the two of a cogroup, that gives memory back after each group."""

    def one(group: pa.Table) -> pa.Table:
        out = task(group)
        give_back()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = task(left, right)
        give_back()
        return out

    return one if task.__code__.co_argcount == 1 else two  # Spark counts the parameters


def text_chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, UTF-8 bytes, offsets) of whole rows, about ``limit`` bytes at a time; null texts are empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        own = offsets[at : end + 1]
        yield slice(at, end), data[own[0] : own[-1]], own - own[0]
        at = end


def cut_chunks(batch: pa.RecordBatch, text: str, breaks: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray, bool, bool]]:
    """As ``text_chunks``, but a text of more than ``limit`` bytes is cut behind bytes of the table ``breaks``.

    The last two values say whether the chunk's first text begins in it and its last
    one ends in it. A run without such a byte stays whole.
    """
    for rows, data, offsets in text_chunks(batch, text, limit):
        if len(data) <= limit or rows.stop - rows.start > 1:
            yield rows, data, offsets, True, True
            continue
        at = 0
        while at < len(data):
            end = min(len(data), at + limit)
            if end < len(data):
                hits = np.flatnonzero(breaks[data[at:end]])
                if len(hits):
                    end = at + int(hits[-1]) + 1
                else:
                    beyond = breaks[data[end:]]
                    end = end + int(beyond.argmax()) + 1 if beyond.any() else len(data)
            yield rows, data[at:end], np.array([0, end - at]), at == 0, end == len(data)
            at = end


class Words:
    """Words of a chunk: ``hash``, ``doc`` (row in the chunk), ``start`` (byte) and ``first``/``count`` of each row.

    ``letters`` holds the lower-cased bytes of all words, one behind the other, from ``begin`` on each.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        n = len(offsets) - 1
        low = LOWER[data]
        keep = table[low]
        edge = offsets[:-1][offsets[:-1] < len(low)]
        before = np.zeros(len(low), bool)
        before[1:] = keep[:-1]
        before[edge] = False
        begins = keep & ~before
        starts = np.flatnonzero(begins)
        inside = low[keep]
        begin_in = np.flatnonzero(begins[keep])
        lens = np.diff(np.append(begin_in, len(inside)))
        self.start, self.letters, self.begin = starts, inside, begin_in
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=n).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        if len(starts):
            powers = np.ones(int(lens.max()), _U)
            powers[1:] = _FACTOR
            powers = np.multiply.accumulate(powers)
            place = np.arange(len(inside)) - np.repeat(begin_in, lens)
            self.hash = mix(np.add.reduceat(_BYTE[inside] * powers[place], begin_in) + lens.astype(_U))
        else:
            self.hash = np.zeros(0, _U)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that would cross a row's end mean nothing."""
        size = len(self.hash) - k + 1
        if size <= 0:
            return np.zeros(0, _U)
        total = np.full(size, k, _U)
        for j in range(k):
            total = total * _GRAM + self.hash[j : size + j]
        return mix(total)

    def gram_starts(self, k: int) -> np.ndarray:
        """Words from which k words of the same row follow."""
        place = np.arange(len(self.hash)) - self.first[self.doc]
        return np.flatnonzero(place + k <= self.count[self.doc])
