"""A table of bits over 64-bit hashes, of one size whatever it is made from.

It drops rows that can't join before they are shuffled. It never drops one that
can; the more hashes it holds, the fewer it drops.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 4 million bits, 512 kB.
BITS = 22


def bit_table(rows: DataFrame, hashed: str, bits: int = BITS) -> bytes:
    """The hashes in column ``hashed`` as ``2 ** bits`` bits, summed up in Spark; at most ``2 ** (bits - 5)`` words come to the driver."""
    slot = F.shiftrightunsigned(hashed, 64 - bits)
    parts = rows.select(F.shiftright(slot, 5).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hashed}, {64 - bits}) & 31 as int))").alias("bit"))
    words = parts.groupBy("at").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 5), "<u4")
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return table.tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """For each unsigned hash: may it be one of the table's?"""
    table = np.frombuffer(bits, np.uint8)
    slot = (hashes >> np.uint64(64 - (8 * len(table) - 1).bit_length())).astype(np.int64)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
