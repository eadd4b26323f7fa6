"""Sets of 64-bit hashes as bit tables of a fixed size, built by executors: false members are possible, missing ones not."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def power_for(bits: int) -> int:
    """The power of two that a table of about ``bits`` bits needs; from 8 KB to 64 MB, beyond which false members grow."""
    return min(29, max(16, int(bits).bit_length()))


def bit_table(hashes: DataFrame, column: str, power: int) -> np.ndarray:
    """A table of 2**power bits with the bit of every hash set; what reaches the driver is bounded by that size."""
    low = F.col(column).bitwiseAND(F.lit((1 << power) - 1).cast("bigint"))
    bit = F.expr(f"shiftleft(1L, cast(`{column}` & 63L AS int))")
    packed = hashes.select(F.shiftright(low, 6).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.uint64)
    out[packed.column("slot").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
    return out


def members(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set."""
    low = hashes & np.uint64(len(table) * 64 - 1)
    return (table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)
