"""Vertex programs as column expressions, and the superstep loop that runs them.

A superstep joins the edges with the state, turns each edge of a vertex that changed (the
frontier) into a message for its target and folds messages and old values by one aggregate. Edges
are partitioned by source once and kept; state is partitioned by id, so that a superstep
shuffles messages only, combined map-side. Several supersteps are planned together;
then state is written to the shared folder, which ends its lineage, and the loop stops
when nothing changed. The edges of hubs, sources of more than HUB edges, are dealt over
all partitions by both ends and meet the hubs' states by broadcast, so that no task
holds all edges of one source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard, static_plans

#: Edges of one source from which they are dealt over all partitions; hubs to broadcast at most.
HUB, HUBS = 1_000_000, 1_000_000


@dataclass(frozen=True)
class VertexProgram:
    """A monotone program: values only improve under ``combine``.

    ``message(value, weight, src)`` is the candidate for an edge's target, ``combine`` the
    aggregate that picks the best of candidates, ``improves(new, old)`` tells whether the
    target changed. ``needs_restart`` says that a deletion can invalidate values.
    """

    message: Callable[[Column, Column, Column], Column]
    combine: Callable[[Column | str], Column]
    improves: Callable[[Column, Column], Column]
    hops: int = 1
    needs_restart: bool = True


BFS = VertexProgram(lambda v, w, s: v + 1, F.min, lambda new, old: new < old)
CC = VertexProgram(lambda v, w, s: v, F.min, lambda new, old: new < old)
SSSP = VertexProgram(lambda v, w, s: v + w, F.min, lambda new, old: new < old)
SSWP = VertexProgram(lambda v, w, s: F.least(v, w), F.max, lambda new, old: new > old)


def seeded(state: DataFrame) -> DataFrame:
    """State (id, value) with every row in the frontier."""
    return state.select(*[c for c in state.columns if c != "changed"], F.lit(True).alias("changed"))


@dataclass(frozen=True)
class Prepared:
    """Kept edges: by source, each vertex with an edge to itself (own); those of hubs apart."""

    light: DataFrame
    heavy: DataFrame | None = None
    hubs: DataFrame | None = None

    def vertices(self) -> DataFrame:
        return self.light.where("own").select(F.col("src").alias("id"))

    def plain(self) -> DataFrame:
        """The edges as they were given."""
        own = self.light.where("not own").drop("own")
        return own if self.heavy is None else own.unionByName(self.heavy.drop("own"))

    def meet(self, state: DataFrame) -> DataFrame:
        """Each edge with the state (id, ...) of its source."""
        met = self.light.join(state, F.col("src") == F.col("id"))
        if self.heavy is None:
            return met
        of_hubs = state.join(F.broadcast(self.hubs), "id", "left_semi")  # at most a row for each hub and key
        return met.unionByName(self.heavy.join(F.broadcast(of_hubs), F.col("src") == F.col("id")))

    def unpersist(self) -> None:
        for df in (self.light, self.heavy, self.hubs):
            if df is not None:
                df.unpersist()


def prepared(edges: DataFrame, ids: DataFrame | None = None, column: str = "weight", own_value: float | None = None, hub: int = HUB, more: tuple[str, ...] = ()) -> Prepared:
    """Edges with ``column`` (and ``more``, null for own edges) by source, and one of each vertex (and of ``ids``) to itself, kept for all supersteps."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("tgt"))
    ends = (ends if ids is None else ends.union(ids.select("id"))).distinct()
    own = ends.select(F.col("id").alias("src"), F.col("id").alias("tgt"), F.lit(own_value).cast("double").alias(column), F.lit(True).alias("own"))
    rows = edges.select("src", "tgt", F.col(column).cast("double"), *more, F.lit(False).alias("own"))
    hubs = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > hub).select("id").persist()
    n = hubs.count()
    if not n or n > HUBS:
        hubs.unpersist()
        return Prepared(rows.unionByName(own, allowMissingColumns=True).repartition("src").persist())
    of = F.broadcast(hubs.withColumnRenamed("id", "src"))
    light = rows.join(of, "src", "left_anti").unionByName(own, allowMissingColumns=True).repartition("src").persist()
    return Prepared(light, rows.join(of, "src", "left_semi").repartition("src", "tgt").persist(), hubs)


def superstep(edges: Prepared, state: DataFrame, program: VertexProgram, keys: tuple[str, ...] = ()) -> DataFrame:
    """One round over ``prepared`` edges: messages of the frontier and old values folded into (keys, id, value, changed).

    ``keys`` are further columns of state, such as a start vertex, that runs are kept apart
    by. Without hubs state is read once, so that the plan of several rounds stays linear:
    each vertex passes its own value on along its edge to itself.
    """
    met = edges.meet(state).where("own or changed")
    value = F.when(F.col("own"), F.col("value")).otherwise(program.message(F.col("value"), F.col("weight"), F.col("src")))
    rows = met.select(*keys, F.col("tgt").alias("id"), value.alias("value"), F.when(F.col("own"), F.col("value")).alias("old"))
    out = rows.groupBy(*keys, "id").agg(program.combine("value").alias("value"), program.combine("old").alias("old"))
    return out.select(*keys, "id", "value", (F.col("old").isNull() | program.improves(F.col("value"), F.col("old"))).alias("changed"))


def run(edges: Prepared, state: DataFrame, program: VertexProgram, max_rounds: int | None = None, together: int = 4, keys: tuple[str, ...] = (), step: Callable[..., DataFrame] = superstep) -> DataFrame:
    """Supersteps from ``state`` (id, value, changed) to the fixpoint; (id, value, changed).

    ``together`` supersteps are planned and run at once: rounds past the fixpoint move nothing.
    A program that has no fixpoint (paths around a cycle of negative weight) needs
    ``max_rounds``: if something still changed in the last of them, RuntimeError is raised.
    """
    together = together if edges.heavy is None else 1
    with static_plans(edges.light.sparkSession):
        done, before = 0, None
        while True:
            for _ in range(together if max_rounds is None else min(together, max_rounds - done)):
                for _ in range(program.hops):
                    state = step(edges, state, program, keys)
                done += 1
            state = cut(state)
            discard(before)
            before = state
            if state.where("changed").isEmpty():
                return state
            if max_rounds is not None and done >= max_rounds:
                raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def trace(edges: Prepared, state: DataFrame, program: VertexProgram, rounds: int | None = None) -> DataFrame:
    """iteration, active_vertices, active_edges, changed of each superstep up to the fixpoint, or of the first ``rounds``."""
    spark = edges.light.sparkSession
    degrees = edges.plain().groupBy("src").agg(F.count("*").alias("d"))
    rows = []
    with static_plans(spark):
        for k in count(1) if rounds is None else range(1, rounds + 1):
            front = state.where("changed").join(degrees, F.col("id") == F.col("src"), "left").agg(F.count("*").alias("v"), F.coalesce(F.sum("d"), F.lit(0)).alias("e")).first()
            state = cut(superstep(edges, state, program))
            n = state.where("changed").count()
            rows.append((k, front["v"], front["e"], n))
            if not n:
                break
    return spark.createDataFrame(rows, "iteration long, active_vertices long, active_edges long, changed long")


def critical(edges: DataFrame, state: DataFrame, program: VertexProgram) -> DataFrame:
    """(id, critical): the smallest in-neighbour whose message is the vertex's value."""
    sent = edges.select("src", "tgt", "weight").join(state.select(F.col("id").alias("src"), F.col("value").alias("v")), "src")
    sent = sent.select("tgt", "src", program.message(F.col("v"), F.col("weight"), F.col("src")).alias("m"))
    return sent.join(state.select(F.col("id").alias("tgt"), "value"), "tgt").where("m = value").groupBy(F.col("tgt").alias("id")).agg(F.min("src").alias("critical"))
