"""Bit sets of 64-bit hashes with a bounded size, built by Spark and broadcast as
prefilters: they let every member through, and some others, which a join removes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOAD = 64             # bits for each hash ...
MAX_BITS = 1 << 29    # ... up to 64 MB; beyond that more non-members pass


def bitmap(hashes: DataFrame, col: str = "h") -> np.ndarray:
    """64-bit words of the bit set over the distinct values of a long column."""
    h = hashes.select(F.col(col).alias("h")).distinct()
    n = h.count()
    bits = min(MAX_BITS, max(1 << 16, 1 << (max(1, n * LOAD) - 1).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    at = F.shiftrightunsigned("h", shift)
    words = (h.groupBy(F.shiftrightunsigned(at, 6).alias("w"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {shift}) & 63 as int))")).alias("v")).toPandas())
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    return out


def contained(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the (uint64) hashes may be members."""
    k = h >> np.uint64(64 - (64 * len(bits)).bit_length() + 1)
    return (bits[k >> np.uint64(6)] >> (k & np.uint64(63))) & np.uint64(1) == 1
