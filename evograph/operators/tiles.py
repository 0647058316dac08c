"""Two-dimensional tiling of the adjacency matrix as derived columns, and its storage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import with_sequence

#: Bytes of an edge in a tile's list, of a local id, of a (source, count) pair.
LIST_EDGE, LOCAL_ID, PAIR = 4, 2, 6


def assign(edges: DataFrame, per_tile: int, per_side: int | None = None) -> DataFrame:
    """Adds tile_x, tile_y; edges outside ``per_side`` tiles are left out."""
    out = edges.withColumns({"tile_x": F.floor(F.col("src") / per_tile).cast("long"), "tile_y": F.floor(F.col("tgt") / per_tile).cast("long")})
    return out if per_side is None else out.where((F.col("tile_x") < per_side) & (F.col("tile_y") < per_side))


def rejected(edges: DataFrame, domain: int) -> DataFrame:
    """Edges with an end outside [0, domain)."""
    return edges.where((F.col("src") < 0) | (F.col("tgt") < 0) | (F.col("src") >= domain) | (F.col("tgt") >= domain))


def sided(of: DataFrame, least: int) -> DataFrame:
    """Adds side: ``least``, doubled until every tile fits."""
    top = of.agg(F.coalesce(F.max(F.greatest("tile_x", "tile_y")), F.lit(0)).alias("top"))  # one row
    side = F.greatest(F.lit(least).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("top"))))
    return of.crossJoin(F.broadcast(top.select(side.alias("side"))))


def tile_id(x: Column, y: Column, per_side: int | Column) -> Column:
    return (x * per_side + y).cast("long")


def tile_cell(t: Column, per_side: int | Column) -> tuple[Column, Column]:
    return F.floor(t / per_side).cast("long"), (t % per_side).cast("long")


def local_id(v: Column, per_tile: int) -> Column:
    """Id inside its tile; ``per_tile`` is a power of two."""
    return v.bitwiseAND(F.lit(per_tile - 1))


def global_id(tile: Column, local: Column, per_tile: int) -> Column:
    return (tile * per_tile).bitwiseOR(local)


def shard(x: Column, y: Column, shards: int) -> Column:
    return ((x + y) % shards).cast("long")


def counts(tiled: DataFrame) -> DataFrame:
    return tiled.groupBy("tile_x", "tile_y").agg(F.count("*").alias("n_edges"))


def layout(tiled: DataFrame, per_tile: int) -> DataFrame:
    """Edges, distinct sources and whether the dense layout (a count for each source of the tile) pays."""
    return tiled.groupBy("tile_x", "tile_y").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources")).withColumn("dense", F.col("n_sources") >= per_tile // 2)


def compact_bytes(of: DataFrame, per_tile: int) -> DataFrame:
    """Bytes of a compacted tile by its layout."""
    heads = F.when(F.col("dense"), F.lit(per_tile * 4)).otherwise(F.col("n_sources") * PAIR)
    return of.withColumn("bytes", (heads + F.col("n_edges") * LOCAL_ID).cast("long"))


def compactions(of: DataFrame, first: int) -> DataFrame:
    """How often each tile is compacted when that happens at ``first`` edges and at each doubling."""
    n = F.when(F.col("n_edges") >= first, F.length(F.bin(F.floor(F.col("n_edges") / first).cast("long")))).otherwise(0)
    return of.withColumn("compactions", n.cast("long"))


def listing(of: DataFrame) -> DataFrame:
    """Tiles by size, largest first, with rank; a row for each tile that is not empty."""
    ranked = with_sequence(of, F.desc("n_edges"), F.asc("tile_x"), F.asc("tile_y"), name="__seq")
    return ranked.select(*of.columns, (F.col("__seq") + 1).cast("int").alias("rank"))


def batches(of: DataFrame, edges: int, tiles: int) -> DataFrame:
    """Runs of tiles in order that hold about ``edges`` edges and ``tiles`` tiles at most, by running sums."""
    nth = with_sequence(of, "tile_x", "tile_y", name="__seq", running="n_edges")
    by = F.floor(F.col("before_n_edges") / edges).cast("long")
    return nth.select("tile_x", "tile_y", "n_edges", by.alias("by_edges"), F.floor(F.col("__seq") / tiles).cast("long").alias("by_tiles"))
