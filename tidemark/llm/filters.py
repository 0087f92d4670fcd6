"""A filter of fixed size for keys: no key that was put in is missed, so a join after it decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 24


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Words of a bit set (2 MB whatever the input) with a bit for each value of the one long column of ``keys``.

    The values should be hashes. With very many keys the set fills up and lets more through; it never grows.
    """
    at = F.pmod(F.col(keys.columns[0]), F.lit(FILTER_BITS))
    bits = keys.select(at.alias("x")).selectExpr("shiftright(x, 6) AS w", "shiftleft(1L, cast(x % 64 AS int)) AS v")
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for row in bits.groupBy("w").agg(F.bit_or("v").alias("v")).toLocalIterator():  # FILTER_BITS / 64 rows at most
        words[row.w] = row.v
    return words


def passes(words: np.ndarray, keys):
    """May the key (or each key of an array) be in the set?"""
    x = keys % FILTER_BITS
    return (words[x >> 6] >> (x & 63)) & 1
