"""PageRank in its forms, reachability, components and paths, from scratch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard, static_plans
from ..sources.graphs import start_vertex
from . import engine

#: PageRank's constants: rank without in-edges, damping.
BASE, DAMPING = 0.15, 0.85


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of every endpoint, by one aggregate over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("tgt").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.in").alias("in_degree"), F.sum("e.out").alias("out_degree"))


def shares(edges: DataFrame) -> engine.Prepared:
    """Edges with the share of the source's rank that each carries, and one without share of each vertex to itself."""
    out = edges.groupBy("src").agg(F.count("*").alias("d"))
    return engine.prepared(edges.join(out, "src").select("src", "tgt", (1 / F.col("d")).alias("share")), column="share", own_value=0.0)


def rounds_of(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, together: int) -> DataFrame:
    """``step`` applied ``rounds`` times, written after every few; what the last writing replaces is removed."""
    before = None
    for k in range(1, rounds + 1):
        state = step(state, k)
        if k % together == 0 or k == rounds:
            state = cut(state)
            discard(before)
            before = state
    return state


def pagerank(edges: DataFrame, rounds: int = 10, together: int = 5) -> DataFrame:
    """(id, rank) after ``rounds``: rank = 0.15 + 0.85 * sum of in-shares, from 1; not normalised, no dangling redistribution."""
    with static_plans(edges.sparkSession):
        share = shares(edges)

        def step(state: DataFrame, k: int) -> DataFrame:
            rows = share.meet(state).select(F.col("tgt").alias("id"), (F.col("rank") * F.col("share")).alias("r"))
            return rows.groupBy("id").agg((BASE + DAMPING * F.sum("r")).alias("rank"))

        out = rounds_of(share.vertices().withColumn("rank", F.lit(1.0)), step, rounds, together if share.heavy is None else 1)
        share.unpersist()
    return out


def pagerank_delta(edges: DataFrame, rounds: int = 10, delta: float = 0.0, drop_small: bool = True, together: int = 5) -> DataFrame:
    """(id, rank): the change of each round is passed on instead of the rank.

    Only changes above ``delta`` times the rank travel on; with ``drop_small`` the others
    are lost, else they are kept back and travel with later ones. With delta 0 every round
    equals PageRank's.
    """
    return pagerank_deltas(edges, (delta,), rounds, drop_small, together).select("id", "rank")


def pagerank_deltas(edges: DataFrame, deltas: tuple[float, ...], rounds: int = 10, drop_small: bool = True, together: int = 5) -> DataFrame:
    """(delta, id, rank) of delta-PageRank for several thresholds, in one run over one kept scan."""
    with static_plans(edges.sparkSession):
        share = shares(edges)
        some = F.explode(F.array(*[F.lit(float(d)) for d in deltas]))
        begin = share.vertices().select(some.alias("delta"), "id", F.lit(0.0).alias("rank"), F.lit(1.0).alias("send"), F.lit(0.0).alias("kept"))

        def step(state: DataFrame, k: int) -> DataFrame:
            # each vertex has an edge to itself that carries its state: state is read once
            met, own = share.meet(state).where("own or send <> 0"), F.col("own")
            rows = met.select("delta", F.col("tgt").alias("id"), F.when(own, F.col("rank")).alias("rank"), F.when(own, F.col("kept")).alias("kept"), F.when(own, 0.0).otherwise(F.col("send") * F.col("share")).alias("s"))
            got = rows.groupBy("delta", "id").agg(F.max("rank").alias("rank"), F.max("kept").alias("kept"), (DAMPING * F.sum("s")).alias("s"))
            # the first round's in-shares stand for the rank of 1 that every vertex began with
            change = F.col("s") + BASE if k == 1 else F.col("s")
            moved = got.select("delta", "id", (F.col("rank") + change).alias("rank"), (change - 1 if k == 1 else change + F.col("kept")).alias("d"))
            far = F.abs("d") > F.col("delta") * F.col("rank")
            return moved.select("delta", "id", "rank", F.when(far, F.col("d")).otherwise(0.0).alias("send"), F.when(far | F.lit(drop_small), 0.0).otherwise(F.col("d")).alias("kept"))

        out = rounds_of(begin, step, rounds, together if share.heavy is None else 1)
        share.unpersist()
    return out.select("delta", "id", "rank")


def settled(edges: DataFrame, state: DataFrame, tolerance: float, together: int = 5) -> DataFrame:
    """(id, rank, rest) of the PageRank equation, from (id, rank, rest): residuals above ``tolerance`` are added and passed on until none is left.

    ``rest`` is what the rank of a vertex lacks, given its in-neighbours' ranks; a smaller
    one stays where it is and travels with later ones.
    """
    with static_plans(edges.sparkSession):
        share, before = shares(edges), None
        state = state.select("id", "rank", "rest")
        while True:
            for _ in range(together if share.heavy is None else 1):
                far, own = F.abs("rest") > tolerance, F.col("own")
                met = share.meet(state).where(own | far)
                rank = F.when(own, F.col("rank") + F.when(far, F.col("rest")).otherwise(0.0)).otherwise(0.0)
                rest = F.when(own, F.when(far, 0.0).otherwise(F.col("rest"))).otherwise(DAMPING * F.col("share") * F.col("rest"))
                state = met.select(F.col("tgt").alias("id"), rank.alias("rank"), rest.alias("rest")).groupBy("id").agg(F.sum("rank").alias("rank"), F.sum("rest").alias("rest"))
            state = cut(state)
            discard(before)
            before = state
            if state.where(F.abs("rest") > tolerance).isEmpty():
                share.unpersist()
                return state


def from_start(edges: DataFrame, value, program: engine.VertexProgram, start: DataFrame | None = None, **kw) -> DataFrame:
    """(id, value) of all that the start vertex reaches, the start having ``value``."""
    start = cut(start_vertex(edges) if start is None else start.select("id"))
    kept = engine.prepared(edges, start)
    begin = engine.seeded(start.select("id", F.lit(value).alias("value")))
    out = engine.run(kept, begin, program, **kw).select("id", "value")
    kept.unpersist()
    return out


def bfs(edges: DataFrame, start: DataFrame | None = None, hops: int = 1) -> DataFrame:
    program = engine.VertexProgram(engine.BFS.message, engine.BFS.combine, engine.BFS.improves, hops)
    return from_start(edges, 0, program, start).select("id", F.col("value").cast("long").alias("dist"))


def sssp(edges: DataFrame, start: DataFrame | None = None, hops: int = 1, delta: float = 0.0) -> DataFrame:
    """(id, dist); with ``delta`` an improvement must exceed it, so that distances are upper bounds."""
    improves = (lambda new, old: new < old - delta) if delta else engine.SSSP.improves
    return from_start(edges, 0.0, engine.VertexProgram(engine.SSSP.message, engine.SSSP.combine, improves, hops), start).select("id", F.col("value").alias("dist"))


def sswp(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(id, width) of all reached vertices but the start, whose width is infinite."""
    return from_start(edges, float("inf"), engine.SSWP, start).where(F.col("value") < float("inf")).select("id", F.col("value").alias("width"))


def components(edges: DataFrame, symmetrize: bool = False, hops: int = 1) -> DataFrame:
    """(id, label): the smallest id that can reach the vertex; of its weak component when ``symmetrize``."""
    if symmetrize:
        edges = edges.unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "weight"))
    kept = engine.prepared(edges)
    begin = engine.seeded(kept.vertices().select("id", F.col("id").alias("value")))
    out = engine.run(kept, begin, engine.VertexProgram(engine.CC.message, engine.CC.combine, engine.CC.improves, hops))
    kept.unpersist()
    return out.select("id", F.col("value").alias("label"))


def bfs_many(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start_id, id, dist) for every start in one run over one scan."""
    kept = engine.prepared(edges, starts)
    begin = engine.seeded(starts.select(F.col("id").alias("start_id"), "id", F.lit(0).cast("long").alias("value")))
    out = engine.run(kept, begin, engine.BFS, keys=("start_id",))
    kept.unpersist()
    return out.select("start_id", "id", F.col("value").alias("dist"))


def quantised(df: DataFrame, column: str, name: str = "rank_q") -> DataFrame:
    """Ranks as whole millionths; the offset moves bucket borders off short decimals, so that noise in the last bits does not show."""
    return df.withColumn(name, F.floor(F.col(column) * 1e6 + 0.3137).cast("long")).drop(column)
