"""Graphs that are derived from the tables: (src, tgt, weight), no loops, parallel edges collapsed to the least weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collapse(edges: DataFrame) -> DataFrame:
    """Set semantics: drops null targets and loops, keeps the least weight of parallel edges."""
    return edges.where("tgt is not null and src <> tgt").groupBy("src", "tgt").agg(F.min("weight").alias("weight"))


def multigraph(lines: DataFrame) -> DataFrame:
    """Each part of ``lines`` to the next part of the same order, parallel edges as they come, no loops."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pairs = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("tgt"), F.col("l_quantity").alias("weight"))
    return pairs.where("tgt is not null and src <> tgt")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part to the next part of the same order, of all orders."""
    return collapse(multigraph(table(spark, sf_dir, "lineitem")))


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to suppliers, whose ids follow the customers'."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    base = orders.agg((F.max("o_custkey") + 1).alias("base"))  # one row
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).crossJoin(F.broadcast(base))
    return pairs.groupBy(F.col("o_custkey").alias("src"), (F.col("base") + F.col("l_suppkey")).alias("tgt")).agg(F.min("l_quantity").alias("weight"))


def vertices(edges: DataFrame) -> DataFrame:
    """Ids of all endpoints."""
    return edges.select(F.col("src").alias("id")).union(edges.select("tgt")).distinct()


def dense_domain(edges: DataFrame) -> DataFrame:
    """All ids of the least power-of-two range that holds every endpoint."""
    top = edges.agg(F.max(F.greatest("src", "tgt"))).first()[0]
    return edges.sparkSession.range(0 if top is None else 1 << max(int(top), 0).bit_length())


def start_vertex(edges: DataFrame) -> DataFrame:
    """One row: the id of the highest out-degree, ties to the smallest."""
    return edges.groupBy(F.col("src").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "weight"))
