"""Joins of a wide table with a smaller one that shuffle little of the wide side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_enough

#: Bits of a filter of keys at most (16 MB).
BLOOM_BITS = 1 << 27


def thinned(big: DataFrame, big_key: Column, keys: DataFrame) -> DataFrame:
    """Rows of ``big`` whose key may be in ``keys`` (one column): a Bloom filter of at most BLOOM_BITS, so that few others are shuffled.

    The filter is bounded: with more keys than it has room for it lets more rows pass, never fewer.
    """
    name = keys.columns[0]
    bits, n = BLOOM_BITS, keys.count()
    while bits > 1 << 16 and bits >= 32 * n:
        bits //= 2
    places = lambda c: F.explode(F.array(*[F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(bits)) for seed in (11, 12)]))
    marks = keys.select(places(F.col(name)).alias("at"))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
    table = marks.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(word).alias("bits")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[table.column(0).to_numpy()] = table.column(1).to_numpy()
    sent = big.sparkSession.sparkContext.broadcast(filled)

    @F.arrow_udf("boolean")
    def passes(a: pa.Array, b: pa.Array) -> pa.Array:
        hit = np.ones(len(a), bool)
        for at in (a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)):
            hit &= (sent.value[at >> 6] >> (at & 63)) & 1 == 1
        return pa.array(hit)

    return big.where(passes(*[F.pmod(F.xxhash64(big_key, F.lit(seed)), F.lit(bits)) for seed in (11, 12)]))


def thin_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str, how: str = "inner") -> DataFrame:
    """Inner or semi join of a wide table on a key of a smaller one: by broadcast, else with the wide side thinned before it is shuffled. Python runs in the latter case."""
    on = F.col(big_key) == F.col(small_key) if big_key != small_key else big_key
    if small_enough(small):
        return big.join(F.broadcast(small), on, how)
    return thinned(big, F.col(big_key), small.select(small_key)).join(small, on, how)
