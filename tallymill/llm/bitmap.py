"""Fixed-size bitmaps of 64-bit values: what is broadcast has a bound that no input exceeds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25


def build(df: DataFrame, value: Column, keep: list[Column] | None = None, bits: int = BITS) -> list[np.ndarray]:
    """For each condition in ``keep`` (default: one that all rows meet), the words of a bitmap of ``2 ** bits`` bits
    with the bit of each value's top ``bits`` bits set.

    Aggregated by word on the executors: at most ``2 ** (bits - 6)`` rows come back.
    """
    keep = [F.lit(True)] if keep is None else keep
    at = df.select(F.shiftrightunsigned(value, 64 - bits).alias("at"), *(c.alias(f"k{k}") for k, c in enumerate(keep)))
    words = at.selectExpr("int(shiftright(at, 6)) AS word", "shiftleft(1L, int(at & 63)) AS bit", *(f"k{k}" for k in range(len(keep))))
    bit = lambda k: F.bit_or(F.when(F.col(f"k{k}"), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"b{k}")
    rows = words.groupBy("word").agg(*map(bit, range(len(keep)))).toArrow()
    out = []
    for k in range(len(keep)):
        out.append(np.zeros(1 << (bits - 6), np.uint64))
        out[-1][rows.column(0).to_numpy()] = rows.column(k + 1).to_numpy().view(np.uint64)
    return out


def test(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each uint64 value's bit is set."""
    bits = len(words).bit_length() - 1 + 6
    at = values >> np.uint64(64 - bits)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
