"""Sorting, comparing and summarising of results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import close, equal_to


def top_k(results: DataFrame, column: str, k: int, ascending: bool = False) -> DataFrame:
    """The k best (id, column) with rank, ties to the smaller id; each task keeps k rows."""
    order = [F.col(column).asc() if ascending else F.col(column).desc(), F.col("id").asc()]
    best = results.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def without_isolated(ranks: DataFrame, least: float = 0.1500001) -> DataFrame:
    return ranks.where(F.col("rank") > least)


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """rank, id_a, id_b of two top lists."""
    return a.select("rank", F.col("id").alias("id_a")).join(b.select("rank", F.col("id").alias("id_b")), "rank")


def footrule(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of rank differences over the ids in both lists."""
    both = a.select("id", F.col("rank").alias("ra")).join(b.select("id", F.col("rank").alias("rb")), "id")
    return both.agg(F.count("*").alias("n_common"), F.coalesce(F.sum(F.abs(F.col("ra") - F.col("rb"))), F.lit(0)).cast("long").alias("footrule"))


def kendall(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Concordant and discordant pairs of two lists of a bounded length k, (tau + 1) / 2 and the p-value in millionths.

    The p-value is the normal approximation's; its complementary error function is a
    polynomial with an error below 2e-7 (Abramowitz and Stegun, 7.1.26).
    """
    p, q = pairs.select("rank", F.col(x).alias("x1"), F.col(y).alias("y1")), pairs.select(F.col("rank").alias("rank2"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    sign = F.signum((F.col("x1") - F.col("x2")).cast("double")) * F.signum((F.col("y1") - F.col("y2")).cast("double"))
    both = p.join(q, F.col("rank") < F.col("rank2")).agg(F.sum(F.when(sign > 0, 1).otherwise(0)).alias("concordant"), F.sum(F.when(sign < 0, 1).otherwise(0)).alias("discordant"), F.count("*").alias("pairs"))
    more = (F.col("concordant") - F.col("discordant")).cast("double")
    n = F.round((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2)
    z = F.abs(3 * more / F.sqrt(n * (n - 1) * (2 * n + 5) / 2))
    t = 1 / (1 + 0.3275911 * z / math.sqrt(2))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z / 2)
    whole = lambda c: F.floor(c * 1e6 + 0.3137).cast("long")
    return both.select("concordant", "discordant", whole((more / F.col("pairs") + 1) / 2).alias("quality_q"), whole(tail).alias("p_q"))


def compare_ranks(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("id", F.col("rank").alias("ra")).join(b.select("id", F.col("rank").alias("rb")), "id")
    return both.agg(F.count("*").alias("n"), F.sum(F.when(equal_to(F.col("ra"), F.col("rb")), 0).otherwise(1)).alias("n_different"))


def compare_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per iteration: ids compared and ids beyond a relative difference of 1e-4."""
    both = a.select("iteration", "id", F.col("rank").alias("ra")).join(b.select("iteration", "id", F.col("rank").alias("rb")), ["iteration", "id"])
    return both.groupBy("iteration").agg(F.count("*").alias("n"), F.sum(F.when(close(F.col("ra"), F.col("rb")), 0).otherwise(1)).alias("n_different"))


def compare_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("id", F.col("label").alias("la")).join(b.select("id", F.col("label").alias("lb")), "id")
    return both.agg(F.count("*").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), 0).otherwise(1)).alias("n_different"), F.countDistinct("la").alias("labels_a"), F.countDistinct("lb").alias("labels_b"))


def canonical(labels: DataFrame) -> DataFrame:
    """Label of each class: the least of its label and its members; aggregate and join back, so a huge class is no single task."""
    least = labels.groupBy("label").agg(F.least(F.min("id"), F.col("label")).alias("canonical"))
    return labels.join(least, "label").select("id", F.col("canonical").alias("label"))


def size_stats(sizes: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return sizes.agg(F.min(c).alias("least"), F.max(c).alias("most"), F.percentile(c, F.lit(0.5)).alias("median"), F.floor(F.avg(c) * 1e6 + 0.3137).cast("long").alias("mean_q"), F.floor(F.stddev_pop(c) * 1e6 + 0.3137).cast("long").alias("stddev_q"))


def interval_deltas(counters: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Differences of a counter between successive intervals, by key."""
    order = Window.partitionBy(key).orderBy(at)
    return counters.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(order), F.lit(0)))
