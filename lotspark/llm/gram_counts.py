"""Exact counts of hashed keys over all tasks, exchanged as arrays instead of rows.

A task sends each bucket of keys one row with all its keys and their counts, so
what is shuffled is a key once per chunk of text, however frequent it is: no
bucket is hot. Buckets are ranges of the hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text_arrays import mix

_U = np.uint64
SENT = "bucket long, chunk long, keys binary, counts binary"


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rising with the key."""
    return ((keys >> _U(33)).astype(np.int64) * buckets) >> 31


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of each one's counts (of occurrences, without counts)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = None
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    total = np.diff(np.append(edge, len(keys))) if order is None else np.add.reduceat(counts[order], edge)
    return keys[edge], total.astype(np.int64)


def sent(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of ``SENT`` for sorted keys; counts go as 32-bit numbers, as a chunk holds no more."""
    at = bucket_of(keys, buckets)
    used, low = np.unique(at, return_index=True)
    high = np.append(low[1:], len(at))
    own = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), chunk)), own(keys), own(counts.astype(np.uint32))], ["bucket", "chunk", "keys", "counts"])


def received(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of all rows of a bucket, one row behind the other, and the number of keys of each row."""
    keys = [np.frombuffer(x.as_buffer(), _U) for x in group.column("keys")]
    counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("counts")]
    return np.concatenate(keys), np.concatenate(counts).astype(np.int64), np.array([len(x) for x in keys], np.int64)


def place(keys: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """One hash of a key and of a chunk that holds it."""
    return mix(keys ^ mix(chunks))


def frequent(rows: DataFrame, least: int) -> DataFrame:
    """(key, n, place) of the keys in rows of ``SENT`` that occur at least ``least`` times; ``place`` is that of one chunk with the key."""

    def count(group: pa.Table) -> pa.Table:
        keys, counts, sizes = received(group)
        if not len(keys):
            return pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "place": pa.array([], pa.int64())})
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(counts[order], edge)
        own = total >= least
        edge = edge[own]
        keys = keys[edge]
        row = np.searchsorted(np.cumsum(sizes), order[edge], "right")
        chunks = group.column("chunk").to_numpy().view(_U)[row]
        return pa.table({"key": keys.view(np.int64), "n": total[own].astype(np.int64), "place": place(keys, chunks).view(np.int64)})

    return rows.groupBy("bucket").applyInArrow(count, "key long, n long, place long")
