"""Numbering of rows in a global order without a global task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def with_sequence(df: DataFrame, *order: str | Column, name: str = "seq", running: str | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... in ``order`` (which should be total); with ``running`` also before_<running>, its sum over the rows before.

    Rows are range-partitioned and sorted, numbered in their partition and shifted by the
    rows of the partitions before; only a row for each partition goes through one task.
    """
    runs = df.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = cut(runs.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")))
    total = F.sum(running) if running else F.lit(0)
    sizes = runs.groupBy("__part").agg(F.count("*").alias("n"), total.alias("s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in "ns"])
    out = runs.join(F.broadcast(starts), "__part").withColumn(name, F.col("__n") + F.col("__at"))
    if running:
        inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"before_{running}", F.col("__s") + F.coalesce(F.sum(running).over(inside), F.lit(0)))
    return out.drop("__part", "__at", "__n", "__s")


def rewritten_ids(edges: DataFrame) -> DataFrame:
    """(old_id, new_id): dense ids in the order in which (seq, src, tgt) shows them first, src before tgt."""
    seen = edges.select(F.explode(F.array(F.struct(F.col("src").alias("old_id"), (2 * F.col("seq")).alias("at")), F.struct(F.col("tgt").alias("old_id"), (2 * F.col("seq") + 1).alias("at")))).alias("s"))
    first = seen.groupBy(F.col("s.old_id").alias("old_id")).agg(F.min("s.at").alias("at"))
    return with_sequence(first, "at", name="new_id").select("old_id", "new_id")


def rewrite(edges: DataFrame) -> DataFrame:
    """seq, src, tgt with dense first-seen ids."""
    ids = rewritten_ids(edges)
    s = ids.select(F.col("old_id").alias("src"), F.col("new_id").alias("new_src"))
    t = ids.select(F.col("old_id").alias("tgt"), F.col("new_id").alias("new_tgt"))
    return edges.join(s, "src").join(t, "tgt").select("seq", F.col("new_src").alias("src"), F.col("new_tgt").alias("tgt"))
