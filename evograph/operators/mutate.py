"""Edge changes: inserts, deletes, the live set after each batch, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more)


def delete(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """All edges but those equal in (src, tgt) to a row of ``gone``; deleting a missing edge does nothing."""
    return edges.join(gone.select("src", "tgt"), ["src", "tgt"], "left_anti")


def exists(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return pairs.join(edges.select("src", "tgt"), ["src", "tgt"], "left_semi")


def sampled(edges: DataFrame, percent: int, salt: int = 0) -> DataFrame:
    """About ``percent`` of the edges, chosen by arithmetic on their ids."""
    return edges.where((F.col("src") * 31 + F.col("tgt") * 17 + salt) % 100 < percent)


def workload(edges: DataFrame, share: float, shards: int) -> DataFrame:
    """In each (batch_id, shard) the first floor(batch size * share / shards) edges in a hashed order."""
    sizes = edges.groupBy("batch_id").agg(F.count("*").alias("size"))
    order = Window.partitionBy("batch_id", "shard").orderBy((F.col("src") * 31 + F.col("tgt") * 17) % 1009, "src", "tgt")
    ranked = edges.withColumn("r", F.row_number().over(order)).join(F.broadcast(sizes), "batch_id")
    return ranked.where(F.col("r") <= F.floor(F.col("size") * share / shards)).select("batch_id", "shard", "src", "tgt")


def live(log: DataFrame, batch: int) -> DataFrame:
    """(src, tgt, weight) whose last change up to ``batch`` is an insert; one combined aggregate, no sort."""
    last = log.where(F.col("batch_id") <= batch).groupBy("src", "tgt").agg(F.max(F.struct("seq", "op", "weight")).alias("last"))
    return last.where("last.op = 'I'").select("src", "tgt", F.col("last.weight").alias("weight"))


def compact(edges: DataFrame) -> DataFrame:
    """Distinct (src, tgt) with the least weight."""
    return edges.groupBy("src", "tgt").agg(F.min("weight").alias("weight"))


def csr(edges: DataFrame) -> DataFrame:
    """Adjacency lists: src, n, sorted distinct targets."""
    lists = edges.groupBy("src").agg(F.sort_array(F.collect_set("tgt")).alias("targets"))
    return lists.select("src", F.size("targets").cast("long").alias("n"), "targets")
