"""Streaming ingestion: edge changes arrive as files, every micro-batch updates log, live edges and results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "seq long, batch_id long, op string, src long, tgt long, weight double"


def ingest(spark: SparkSession, source: str, log: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, files_each: int = 1) -> None:
    """Reads Parquet change files in arrival order, appends each micro-batch to ``log`` and then calls ``on_batch(live, n)``.

    A micro-batch is written under its own number and overwrites an earlier try, so that a
    repeated one counts once. Ends when all files that are there have been read. The live
    set is a base, the live edges after some micro-batch, and the log since then; the log
    is folded into a new base when it has grown as large as the base, so that all folding
    together is in proportion to the log.
    """
    bases = {-1: (None, 0)}  # micro-batch: its live edges and their number

    def since(n: int) -> tuple[int, DataFrame]:
        """The last base before micro-batch ``n``, and its edges with the changes after it."""
        at = max(k for k in bases if k < n)
        parts = [spark.read.parquet(f"{log}/micro_batch={k}").select("seq", "op", "src", "tgt", "weight") for k in range(at + 1, n + 1)]
        if bases[at][0]:
            base = spark.read.parquet(bases[at][0])
            parts.append(base.select(F.lit(None).cast("long").alias("seq"), F.lit("I").alias("op"), "src", "tgt", "weight"))
        return at, reduce(DataFrame.unionByName, parts)

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/micro_batch={n}")
        for k in [k for k in bases if k >= n]:  # of an earlier try
            del bases[k]
        if on_batch is None:
            return
        at, changes = since(n)
        # an edge of the base has no number: every change comes after it
        last = changes.groupBy("src", "tgt").agg(F.max(F.struct("seq", "op", "weight")).alias("last"))
        live = last.where("last.op = 'I'").select("src", "tgt", F.col("last.weight").alias("weight"))
        if changes.where("seq is not null").count() > bases[at][1]:
            path = f"{checkpoint}-live/{n}"
            live.write.mode("overwrite").parquet(path)
            live = spark.read.parquet(path)
            bases[n] = (path, live.count())
        on_batch(live, n)

    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_each).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counts_by_batch(log: DataFrame) -> DataFrame:
    """Inserts and deletes of each micro-batch."""
    return log.groupBy("micro_batch").agg(F.sum(F.when(F.col("op") == "I", 1).otherwise(0)).alias("inserts"), F.sum(F.when(F.col("op") == "D", 1).otherwise(0)).alias("deletes"))
