"""Shared storage of a session: where iterations cut their lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Threads must not switch a setting for each other.
_PLANNING = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or the folder set on its context.

    Where neither is set, a temporary folder serves a local session, as in tests; the
    executors of a cluster would not see it, so there it is an error.
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


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; its partitioning stays known, its lineage ends, the files of its shuffles go."""
    shared_dir(df.sparkSession)
    with _PLANNING, setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df = df.select("*")  # holds the setting of this time
    return df.checkpoint(eager=True)


def discard(*tables: DataFrame | None) -> None:
    """Removes the files of tables that ``cut`` made and that nothing reads any more."""
    for df in tables:
        plan = None if df is None else df._jdf.queryExecution().analyzed()
        if plan is not None and plan.getClass().getSimpleName() == "LogicalRDD" and (file := plan.rdd().getCheckpointFile()).isDefined():
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Inside, the session's ``key`` is ``value``."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def static_plans(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, plans are not changed at run time: a superstep's partitioning carries over to the next."""
    return setting(spark, "spark.sql.adaptive.enabled", "false")
