"""A bitmap of fixed size over 64-bit hashes, to leave out early most rows that a later exact join would drop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build(hashes: DataFrame, column: Column, bits: int) -> np.ndarray:
    """The bitmap of the top `bits` bits of each hash. Its 2**(bits - 3) bytes do not grow with the data: beyond it, it only lets more through."""
    words = (
        hashes.where(column.isNotNull())
        .select(F.shiftrightunsigned(column, 64 - bits).alias("place"))
        .selectExpr("shiftrightunsigned(place, 6) AS word", "shiftleft(1L, cast(place % 64 AS int)) AS bit")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bit").to_numpy().view(np.uint64)
    return out


def passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = int(np.log2(len(sieve))) + 6
    place = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return ((sieve[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
