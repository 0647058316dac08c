"""Space-filling orders of an n by n grid (n a power of two), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1)]


def hilbert_index(x: Column, y: Column, n: int) -> Column:
    """Distance along the Hilbert curve of cell (x, y); one step for each bit, from the highest.

    Steps are struct-valued lets over an array of bits, so that the expression grows
    with log2 n only.
    """
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(a: Column, s: Column) -> Column:
        rx, ry = F.when(a["x"].bitwiseAND(s) > 0, 1).otherwise(0), F.when(a["y"].bitwiseAND(s) > 0, 1).otherwise(0)
        flip = (ry == 0) & (rx == 1)
        # the low bits are mirrored inside the quadrant, then the axes change places
        u, v = F.when(flip, n - 1 - a["x"]).otherwise(a["x"]), F.when(flip, n - 1 - a["y"]).otherwise(a["y"])
        d = a["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        return F.struct(F.when(ry == 0, v).otherwise(u).alias("x"), F.when(ry == 0, u).otherwise(v).alias("y"), d.alias("d"))

    order = F.array(*[F.lit(s).cast("long") for s in reversed(_bits(n))]) if n > 1 else F.array().cast("array<long>")
    return F.aggregate(order, start, step, lambda a: a["d"])


def hilbert_cell(d: Column, n: int) -> Column:
    """struct<x, y> of the cell at distance d."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), d.cast("long").alias("t"))

    def step(a: Column, s: Column) -> Column:
        rx = F.shiftright(a["t"], 1).bitwiseAND(F.lit(1))
        ry = a["t"].bitwiseXOR(rx).bitwiseAND(F.lit(1))
        flip = (ry == 0) & (rx == 1)
        u, v = F.when(flip, s - 1 - a["x"]).otherwise(a["x"]), F.when(flip, s - 1 - a["y"]).otherwise(a["y"])
        return F.struct((F.when(ry == 0, v).otherwise(u) + s * rx).alias("x"), (F.when(ry == 0, u).otherwise(v) + s * ry).alias("y"), F.shiftright(a["t"], 2).alias("t"))

    order = F.array(*[F.lit(s).cast("long") for s in _bits(n)]) if n > 1 else F.array().cast("array<long>")
    return F.aggregate(order, start, step, lambda a: F.struct(a["x"].cast("long").alias("x"), a["y"].cast("long").alias("y")))


def row_index(x: Column, y: Column, n: int | Column) -> Column:
    return (y * n + x).cast("long")


def row_cell(d: Column, n: int) -> Column:
    return F.struct((d % n).cast("long").alias("x"), F.floor(d / n).cast("long").alias("y"))


def column_index(x: Column, y: Column, n: int) -> Column:
    return (x * n + y).cast("long")


def column_cell(d: Column, n: int) -> Column:
    return F.struct(F.floor(d / n).cast("long").alias("x"), (d % n).cast("long").alias("y"))


ORDERS = {"hilbert": hilbert_index, "row": row_index, "column": column_index}


def order_of(kind: str, x: Column, y: Column, n: int) -> Column:
    """Traversal id of a tile by the named order."""
    return ORDERS[kind](x, y, n)
