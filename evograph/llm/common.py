"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contract: U+0020 and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]"

#: Rows and bytes up to which a keyed side table is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one set on the context.

    Where neither is set, a temporary folder serves a local session; a cluster's executors
    would not see it, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="evograph-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Removes what ``stored`` wrote for tables that nothing reads any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "_stored_at", None)):
            jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, fold) -> Column:
    """Array of ``fold`` over each prefix of an array (fold must be associative), in log2(size) passes of whole-array steps."""
    passes = F.sequence(F.lit(0), F.length(F.bin(F.size(values).cast("long"))))

    def one(acc: Column, k: Column) -> Column:
        by = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= by, fold(F.get(acc, i - by), x)).otherwise(x))

    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(passes, values, one))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"__{stem}_{n}"
    return name


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return 8 * (len(kind.elementType) + 1) * F.coalesce(F.size(c), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def small_enough(df: DataFrame) -> bool:
    """Whether ``df`` may be broadcast: few rows, and few bytes by the sizes of its own columns."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8))
    got = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return got["n"] <= BROADCAST_ROWS and got["bytes"] <= BROADCAST_BYTES


def sized_join(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join that broadcasts ``small`` only when its counted rows and bytes are few."""
    return big.join(F.broadcast(small) if small_enough(small) else small, on, how)


def few_rows(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in slices of a few rows: what Python makes of long texts is small at any time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def held_out(doc_id: Column) -> Column:
    """True for ids whose crc32, as text, is 2 modulo 4 (null ids: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
