"""Scalar helpers: powers of two, tolerant comparison, wrapping integer hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log2_up(x: Column) -> Column:
    """Least k with 2**k >= x (0 for x <= 1); exact, from the length of the binary form."""
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin(x - 1))).cast("long")


def next_power(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), log2_up(x).cast("int"))


def previous_power(x: Column) -> Column:
    """Greatest power of two that is at most x, for x >= 1."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x)) - 1)


def round_up(x: Column, unit: int) -> Column:
    """Least multiple of ``unit`` (a power of two) that is at least x."""
    return (x + (unit - 1)).bitwiseAND(F.lit(~(unit - 1)).cast("long"))


def close(a: Column, b: Column, relative: float = 1e-4) -> Column:
    """Relative difference, by the larger absolute value, within tolerance."""
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def equal_to(a: Column, b: Column, digits: int = 4) -> Column:
    """Equal when cut off (not rounded) after ``digits`` decimals, as the decimal numbers that they are written as.

    The product with a power of ten may fall on the wrong side of a whole number; quotients
    are rounded as decimals are, so they tell on which side a number is.
    """
    unit = 10.0**digits

    def cut(x: Column) -> Column:
        size = F.abs(x)
        k = F.floor(size * unit).cast("double")
        return F.signum(x) * F.when((k + 1) / unit <= size, k + 1).when(k / unit > size, k - 1).otherwise(k)

    return cut(a) == cut(b)


def sorted_with(keys: Column, *others: Column) -> Column:
    """Arrays put in the order of ``keys``, ties in their own order: array of structs (key, position, others...)."""
    return F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at"), *[F.get(o, i).alias(f"o{n}") for n, o in enumerate(others)])))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on wrapping unsigned numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijective 32-bit finaliser."""
    x = x.astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def unit_interval(h: np.ndarray) -> np.ndarray:
    """64-bit hashes to doubles in [0, 1)."""
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


@F.pandas_udf(T.LongType())
def hash64(x: pd.Series) -> pd.Series:
    return pd.Series(mix64(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(T.LongType())
def hash32(x: pd.Series) -> pd.Series:
    return pd.Series(mix32(x.to_numpy(np.int64).astype(np.uint32)).astype(np.int64))


@F.pandas_udf(T.DoubleType())
def hash_unit(x: pd.Series) -> pd.Series:
    return pd.Series(unit_interval(mix64(x.to_numpy(np.int64).view(np.uint64))))


def drawn_weight(src: Column, tgt: Column, levels: int = 1000) -> Column:
    """A weight in [0, 1) that depends on the edge only, so that reruns agree; plain arithmetic."""
    return (F.pmod(src * 7919 + tgt * 104729, F.lit(levels)) / levels).cast("double")
