"""Named queries of the graph engine, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jobs
from ..functions import curves, scalars
from ..operators import algorithms, engine, incremental, mutate, post, tiles
from ..operators.sequence import rewrite, rewritten_ids, with_sequence
from ..session import cut, scratch_path
from ..sources import edge_io, graphs
from ..sources.graphs import table
from ..streaming import runner
from . import oracles as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its own name, with its SQL."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


PER_TILE, SHARDS = 64, 6
GE = f"WITH {o.G}, {o.E} "


def g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph that queries read: all orders."""
    return graphs.dense(spark, sf_dir)


@contextmanager
def kept(edges: DataFrame) -> Iterator[DataFrame]:
    """A scan that several algorithms read; what they return must not depend on it any more."""
    shared = edges.persist()
    try:
        yield shared
    finally:
        shared.unpersist()


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's edges with seq in the order of (src, tgt)."""
    return with_sequence(g(spark, sf_dir), "src", "tgt")


# --- sources, sinks, ingestion ---------------------------------------------------


@query(f"WITH RECURSIVE {o.G} SELECT src, tgt FROM g")
def scan_binary_edges(spark, sf_dir):
    path = scratch_path(spark, "binary")
    edge_io.write_binary(g(spark, sf_dir), path)
    return edge_io.read_binary(spark, path)


@query(f"WITH RECURSIVE {o.G} SELECT src, tgt, weight FROM g")
def scan_csv_edges(spark, sf_dir):
    path = scratch_path(spark, "csv")
    g(spark, sf_dir).select("src", "tgt", "weight").write.csv(path)
    return edge_io.read_csv(spark, path)


@query(f"WITH RECURSIVE {o.G} SELECT src, tgt FROM g")
def convert_text_edges(spark, sf_dir):
    path = scratch_path(spark, "text")
    lines = g(spark, sf_dir).select(F.concat_ws("\t", "src", "tgt").alias("value"))
    lines.unionAll(spark.createDataFrame([("# src tgt",)], "value string")).write.text(path)
    return edge_io.parse_text(spark.read.text(path))


@query(f"WITH RECURSIVE {o.G} SELECT src, tgt FROM g")
def adjacency_to_edges(spark, sf_dir):
    lists = mutate.csr(g(spark, sf_dir)).select(F.concat_ws(" ", "src", "n", F.array_join(F.col("targets").cast("array<string>"), " ")).alias("value"))
    return edge_io.parse_adjacency(lists.unionAll(spark.createDataFrame([("7 0",), ("8",)], "value string")))


def _log(spark, sf_dir) -> str:
    path = scratch_path(spark, "edge-log")
    tiled = tiles.assign(numbered(spark, sf_dir), PER_TILE)
    edge_io.write_log(tiled.withColumn("shard", tiles.shard(F.col("tile_x"), F.col("tile_y"), SHARDS)).select("seq", "src", "tgt", "weight", "shard"), path)
    return path


SHARD_SQL = f"(src // {PER_TILE} + tgt // {PER_TILE}) % {SHARDS}"


@query(f"WITH RECURSIVE {o.G} SELECT src, tgt, weight, CAST({SHARD_SQL} AS BIGINT) AS shard FROM g")
def write_edge_log(spark, sf_dir):
    return edge_io.read_log(spark, _log(spark, sf_dir)).select("src", "tgt", "weight", F.col("shard").cast("long").alias("shard"))


@query(f"WITH RECURSIVE {o.G} SELECT src, sum(weight) AS weight, count(*) AS n FROM g GROUP BY src")
def replay_edge_log(spark, sf_dir):
    return edge_io.read_log(spark, _log(spark, sf_dir)).groupBy("src").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


@query(f"WITH RECURSIVE {o.G} SELECT CAST({SHARD_SQL} AS BIGINT) AS shard, count(*) AS n_edges FROM g GROUP BY 1")
def edge_log_count(spark, sf_dir):
    return edge_io.read_log(spark, _log(spark, sf_dir)).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n_edges"))


@query(GE + "SELECT seq, src, tgt FROM e WHERE seq >= 100")
def resume_from_log(spark, sf_dir):
    """Edges that a log of the first 100 has not yet."""
    edges = cut(numbered(spark, sf_dir))
    path = scratch_path(spark, "edge-log")
    edge_io.write_log(edges.where("seq < 100").withColumn("shard", F.lit(0)), path)
    done = edge_io.read_log(spark, path).agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("done"))
    return edges.join(F.broadcast(done), F.col("seq") >= F.col("done")).select("seq", "src", "tgt")


@query(f"WITH RECURSIVE {o.G}, {o.S}, {o.BFS_FIX} SELECT CAST(k AS BIGINT) AS batch_id, id, value AS dist FROM r, range(0, 2) t(k)")
def snapshot_results(spark, sf_dir):
    """Results of two batches written as snapshots and read back."""
    path, dist = scratch_path(spark, "snapshots"), algorithms.bfs(g(spark, sf_dir))
    for k in range(2):
        edge_io.write_snapshot(dist.withColumn("batch_id", F.lit(k)), path)
    return spark.read.parquet(path).select(F.col("batch_id").cast("long").alias("batch_id"), "id", "dist")


FIRST_SEEN = GE + """, f AS (SELECT id, min(pos) AS pos FROM (SELECT src AS id, 2 * seq AS pos FROM e UNION ALL SELECT tgt, 2 * seq + 1 FROM e) GROUP BY id),
    n AS (SELECT id, row_number() OVER (ORDER BY pos) - 1 AS new_id FROM f) """


@query(FIRST_SEEN + "SELECT seq, s.new_id AS src, t.new_id AS tgt FROM e JOIN n s ON e.src = s.id JOIN n t ON e.tgt = t.id")
def rewrite_ids(spark, sf_dir):
    return rewrite(cut(numbered(spark, sf_dir)))


@query(FIRST_SEEN + "SELECT id AS old_id, new_id FROM n")
def rewrite_ids_online(spark, sf_dir):
    return rewritten_ids(cut(numbered(spark, sf_dir)))


@query(GE + "SELECT seq, src, tgt FROM e WHERE seq < 1000")
def limit_edges(spark, sf_dir):
    return numbered(spark, sf_dir).where("seq < 1000").select("seq", "src", "tgt")


@query(GE + "SELECT seq // 500 AS batch_id, count(*) AS n_edges, min(src) AS first_src, max(src) AS last_src FROM e GROUP BY 1")
def batch_edges(spark, sf_dir):
    batches = numbered(spark, sf_dir).withColumn("batch_id", F.floor(F.col("seq") / 500))
    return batches.groupBy("batch_id").agg(F.count("*").alias("n_edges"), F.min("src").alias("first_src"), F.max("src").alias("last_src"))


@query(f"WITH RECURSIVE {o.G} SELECT count(*) AS n_edges, sum(weight) AS weight FROM g")
def in_memory_ingest(spark, sf_dir):
    with kept(g(spark, sf_dir)) as e:
        e.count()
        return cut(e.agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight")))


@query(f"WITH RECURSIVE {o.G}, {o.V}, d AS (SELECT src AS id, count(*) AS n FROM g GROUP BY src), m AS (SELECT tgt AS id, min(weight) AS w FROM g GROUP BY tgt) SELECT v.id, coalesce(n, 0) AS out_degree, w AS least_weight FROM v LEFT JOIN d ON v.id = d.id LEFT JOIN m ON v.id = m.id")
def shared_scan_multi(spark, sf_dir):
    """Two aggregates over one scan of the edges."""
    ends = g(spark, sf_dir).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("n"), F.lit(None).cast("double").alias("w")), F.struct(F.col("tgt").alias("id"), F.lit(0).alias("n"), F.col("weight").alias("w")))).alias("x"))
    return ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.n").alias("out_degree"), F.min("x.w").alias("least_weight"))


@query(f"WITH RECURSIVE {o.G}, {o.V} SELECT count(*) AS n_vertices FROM v")
def count_vertices(spark, sf_dir):
    return graphs.vertices(g(spark, sf_dir)).agg(F.count("*").alias("n_vertices"))


@query(f"WITH RECURSIVE {o.G} SELECT src, tgt, (src * 7919 + tgt * 104729) % 1000 / 1000.0::DOUBLE AS weight FROM g")
def attach_weights(spark, sf_dir):
    return g(spark, sf_dir).select("src", "tgt", scalars.drawn_weight(F.col("src"), F.col("tgt")).alias("weight"))


def _rmat_sql(scale: int, edges: int) -> str:
    """The generator's arithmetic on unsigned numbers: at each level a hash of the edge's number picks the quadrant."""
    a, ab, abc = edge_io.A, edge_io.A + edge_io.B, edge_io.A + edge_io.B + edge_io.C
    draws, src, tgt = [], [], []
    for k in range(scale):
        level = int(scalars.mix64(np.array([k + 1], np.uint64))[0])
        draws.append(f"{o.unit(o.mix64(f'xor(base, {level}::UBIGINT)'))} AS r{k}")
        bit = 1 << (scale - 1 - k)
        src.append(f"(CASE WHEN r{k} >= {ab!r}::DOUBLE THEN {bit} ELSE 0 END)")
        tgt.append(f"(CASE WHEN (r{k} >= {a!r}::DOUBLE AND r{k} < {ab!r}::DOUBLE) OR r{k} >= {abc!r}::DOUBLE THEN {bit} ELSE 0 END)")
    start = f"CAST((CAST(seq AS UHUGEINT) + {edge_io.SEED * edge_io.STRIDE % (1 << 64)}::UHUGEINT) % {1 << 64}::UHUGEINT AS UBIGINT)"
    return f"""WITH n AS (SELECT seq, {start} AS first FROM range(0, {edges}) t(seq)), b AS (SELECT seq, {o.mix64('first')} AS base FROM n), d AS (SELECT seq, {', '.join(draws)} FROM b)
        SELECT seq, CAST({' + '.join(src)} AS BIGINT) AS src, CAST({' + '.join(tgt)} AS BIGINT) AS tgt FROM d"""


@query(_rmat_sql(10, 1 << 14))
def gen_rmat(spark, sf_dir):
    return edge_io.rmat(spark, 10, 1 << 14)


# --- graphs ----------------------------------------------------------------------


@query(o.parts_in_order())
def g_dense(spark, sf_dir):
    return graphs.dense(spark, sf_dir)


@query("""SELECT o_custkey AS src, m.base + l_suppkey AS tgt, min(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    CROSS JOIN (SELECT max(o_custkey) + 1 AS base FROM orders) m GROUP BY o_custkey, m.base + l_suppkey""")
def g_bip(spark, sf_dir):
    return graphs.bipartite(spark, sf_dir)


@query("""SELECT src, tgt, min(weight) AS weight FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS tgt, value AS weight FROM events) t
    WHERE tgt IS NOT NULL AND src <> tgt GROUP BY src, tgt""")
def g_events(spark, sf_dir):
    """Consecutive users in time order, joined by their places in a distributed numbering."""
    seq = with_sequence(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "ts", "event_id")
    after = seq.select((F.col("seq") - 1).alias("seq"), F.col("user_id").alias("tgt"))
    return graphs.collapse(seq.join(after, "seq").select(F.col("user_id").alias("src"), "tgt", F.col("value").alias("weight")))


@query(f"WITH RECURSIVE {o.G}, m AS (SELECT max(greatest(src, tgt)) AS t FROM g) SELECT unnest(range(0, CAST(pow(2, length(bin(t))) AS BIGINT))) AS id FROM m".replace("bin(t)", "ltrim(CAST(CAST(t AS BIT) AS VARCHAR), '0')"))
def dense_domain(spark, sf_dir):
    return graphs.dense_domain(g(spark, sf_dir))


# --- storage ---------------------------------------------------------------------


@query(f"WITH RECURSIVE {o.G} SELECT src, tgt, count(*) AS n FROM (SELECT src, tgt FROM g UNION ALL SELECT src, tgt FROM g WHERE src % 10 = 0) GROUP BY src, tgt")
def insert_edges(spark, sf_dir):
    e = g(spark, sf_dir)
    return mutate.insert(e, e.where("src % 10 = 0")).groupBy("src", "tgt").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {o.G} SELECT src, tgt, weight FROM g WHERE NOT (src % 10 = 3)")
def delete_edges(spark, sf_dir):
    e = g(spark, sf_dir)
    return mutate.delete(e, e.where("src % 10 = 3")).select("src", "tgt", "weight")


@query(f"WITH RECURSIVE {o.G} SELECT src, tgt, weight FROM g WHERE NOT ((src * 31 + tgt * 17) % 100 < 5)")
def delete_sampled(spark, sf_dir):
    e = g(spark, sf_dir)
    return mutate.delete(e, mutate.sampled(e, 5)).select("src", "tgt", "weight")


@query(GE + f""", t AS (SELECT *, seq // 500 AS batch_id, {SHARD_SQL} AS shard FROM e), n AS (SELECT batch_id, count(*) AS size FROM t GROUP BY 1),
    r AS (SELECT t.*, size, row_number() OVER (PARTITION BY t.batch_id, shard ORDER BY (src * 31 + tgt * 17) % 1009, src, tgt) AS r FROM t JOIN n ON t.batch_id = n.batch_id)
    SELECT batch_id, CAST(shard AS BIGINT) AS shard, src, tgt FROM r WHERE r <= floor(size * 0.05 / {SHARDS})""")
def deletion_workload(spark, sf_dir):
    tiled = tiles.assign(numbered(spark, sf_dir), PER_TILE).withColumn("shard", tiles.shard(F.col("tile_x"), F.col("tile_y"), SHARDS))
    return mutate.workload(tiled.withColumn("batch_id", F.floor(F.col("seq") / 500)), 0.05, SHARDS)


@query(f"WITH RECURSIVE {o.G} SELECT src, tgt FROM g WHERE src % 7 = 0")
def edge_exists(spark, sf_dir):
    e = g(spark, sf_dir)
    asked = e.where("src % 7 = 0").select("src", "tgt").unionAll(e.where("src % 7 = 0").select("src", (-F.col("tgt") - 1).alias("tgt")))
    return mutate.exists(asked, e)


@query(f"WITH RECURSIVE {o.G} SELECT count(*) AS n_edges FROM g")
def count_edges(spark, sf_dir):
    return g(spark, sf_dir).agg(F.count("*").alias("n_edges"))


TILED = f"WITH RECURSIVE {o.G}, t AS (SELECT *, src // {PER_TILE} AS tile_x, tgt // {PER_TILE} AS tile_y FROM g), c AS (SELECT tile_x, tile_y, count(*) AS n_edges, count(DISTINCT src) AS n_sources FROM t GROUP BY 1, 2) "


def _tiled(spark, sf_dir) -> DataFrame:
    return tiles.assign(g(spark, sf_dir), PER_TILE)


@query(TILED + "SELECT src, tgt, tile_x, tile_y FROM t")
def tile_assign(spark, sf_dir):
    return _tiled(spark, sf_dir).select("src", "tgt", "tile_x", "tile_y")


@query(TILED + f"SELECT tile_x, tile_y, CAST(CASE WHEN n_sources >= {PER_TILE // 2} THEN {PER_TILE * 4} ELSE n_sources * 6 END + n_edges * 2 AS BIGINT) AS bytes FROM c")
def tile_bytes(spark, sf_dir):
    return tiles.compact_bytes(tiles.layout(_tiled(spark, sf_dir), PER_TILE), PER_TILE).select("tile_x", "tile_y", "bytes")


@query(TILED + f"SELECT n_sources >= {PER_TILE // 2} AS dense, count(*) AS n_tiles FROM c GROUP BY 1")
def compact_layout_tiles(spark, sf_dir):
    return tiles.layout(_tiled(spark, sf_dir), PER_TILE).groupBy("dense").agg(F.count("*").alias("n_tiles"))


@query("""SELECT src, tgt, min(weight) AS weight FROM (SELECT l_partkey AS src, l_suppkey AS tgt, l_quantity AS weight FROM lineitem) GROUP BY src, tgt""")
def compact_edges(spark, sf_dir):
    """A multigraph, parts to suppliers, compacted."""
    return mutate.compact(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("tgt"), F.col("l_quantity").alias("weight")))


@query(f"WITH RECURSIVE {o.G} SELECT src, count(*) AS n, string_agg(CAST(tgt AS VARCHAR), ' ' ORDER BY tgt) AS targets FROM g GROUP BY src")
def csr_view(spark, sf_dir):
    return mutate.csr(g(spark, sf_dir)).select("src", "n", F.array_join(F.col("targets").cast("array<string>"), " ").alias("targets"))


@query(TILED + "SELECT tile_x, tile_y, n_edges, CAST(CASE WHEN n_edges >= 4 THEN floor(log2(n_edges // 4)) + 1 ELSE 0 END AS BIGINT) AS compactions FROM c")
def compaction_schedule(spark, sf_dir):
    return tiles.compactions(tiles.counts(_tiled(spark, sf_dir)), 4)


@query(f"WITH RECURSIVE {o.G}, {o.V} SELECT v.id, coalesce((SELECT count(*) FROM g WHERE tgt = v.id), 0) AS in_degree, coalesce((SELECT count(*) FROM g WHERE src = v.id), 0) AS out_degree FROM v")
def degrees(spark, sf_dir):
    return algorithms.degrees(g(spark, sf_dir))


def tile_ids(tiled: DataFrame) -> DataFrame:
    """tile_x, tile_y, tile_id and the cell that the id stands for."""
    t = tiles.sided(tiled.select("tile_x", "tile_y").distinct(), 4096).withColumn("tile_id", tiles.tile_id(F.col("tile_x"), F.col("tile_y"), F.col("side")))
    x, y = tiles.tile_cell(F.col("tile_id"), F.col("side"))
    return t.withColumns({"back_x": x, "back_y": y}).drop("side")


def meta_tiles(tiled: DataFrame) -> DataFrame:
    """tile_x, tile_y and their meta tile by rows and by cells."""
    t = tiles.sided(tiles.counts(tiled), 4096)
    at = F.floor(curves.row_index(F.col("tile_x"), F.col("tile_y"), F.col("side")) / 16)
    return t.select("tile_x", "tile_y", at.alias("meta"), F.floor(F.col("tile_x") / 4).alias("meta_x"), F.floor(F.col("tile_y") / 4).alias("meta_y"))


#: A grid of 4096 tiles a side, doubled until all fit.
SIDED = TILED + ", side AS (SELECT greatest(4096, CAST(pow(2, ceil(log2(max(greatest(tile_x, tile_y)) + 1))) AS BIGINT)) AS side FROM t) "


@query(SIDED + "SELECT DISTINCT tile_x, tile_y, tile_x * side + tile_y AS tile_id, tile_x AS back_x, tile_y AS back_y FROM t, side")
def tile_coords(spark, sf_dir):
    return tile_ids(_tiled(spark, sf_dir))


@query(f"WITH RECURSIVE {o.G} SELECT src, src % {PER_TILE} AS local_src, src AS global_src FROM (SELECT DISTINCT src FROM g)")
def local_global_ids(spark, sf_dir):
    ids = g(spark, sf_dir).select("src").distinct().withColumn("local_src", tiles.local_id(F.col("src"), PER_TILE))
    return ids.withColumn("global_src", tiles.global_id(F.floor(F.col("src") / PER_TILE), F.col("local_src"), PER_TILE))


@query(TILED + f"SELECT CAST({SHARD_SQL} AS BIGINT) AS shard, count(*) AS n_edges FROM t GROUP BY 1")
def shard_assign(spark, sf_dir):
    return _tiled(spark, sf_dir).groupBy(tiles.shard(F.col("tile_x"), F.col("tile_y"), SHARDS).alias("shard")).agg(F.count("*").alias("n_edges"))


@query(SIDED + "SELECT tile_x, tile_y, (tile_y * side + tile_x) // 16 AS meta, tile_x // 4 AS meta_x, tile_y // 4 AS meta_y FROM c, side")
def meta_tile_assign(spark, sf_dir):
    return meta_tiles(_tiled(spark, sf_dir))


@query(TILED + "SELECT tile_x // 4 AS meta_x, tile_y // 4 AS meta_y, count(*) AS n_edges FROM t GROUP BY 1, 2")
def meta_tile_counts(spark, sf_dir):
    return _tiled(spark, sf_dir).groupBy(F.floor(F.col("tile_x") / 4).alias("meta_x"), F.floor(F.col("tile_y") / 4).alias("meta_y")).agg(F.count("*").alias("n_edges"))


@query(TILED + "SELECT tile_x, tile_y, n_edges, CAST(row_number() OVER (ORDER BY n_edges DESC, tile_x, tile_y) AS INTEGER) AS rank FROM c")
def tile_stats(spark, sf_dir):
    return tiles.listing(tiles.counts(_tiled(spark, sf_dir)))


@query(TILED + f"SELECT count(*) AS n_tiles, {o.quant('avg(n_edges)', 'mean_q')}, {o.quant('stddev_pop(n_edges)', 'stddev_q')} FROM c")
def tile_dist_stats(spark, sf_dir):
    q = lambda c, n: F.floor(c * 1e6 + 0.3137).cast("long").alias(n)
    return tiles.counts(_tiled(spark, sf_dir)).agg(F.count("*").alias("n_tiles"), q(F.avg("n_edges"), "mean_q"), q(F.stddev_pop("n_edges"), "stddev_q"))


# --- curves ----------------------------------------------------------------------

CELLS = "c AS (SELECT x, y FROM range(0, 32) a(x), range(0, 32) b(y))"


def _hilbert_sql() -> str:
    steps, last = ["h5 AS (SELECT x AS x0, y AS y0, x, y, CAST(0 AS BIGINT) AS d FROM c)"], "h5"
    for k in range(4, -1, -1):
        s = 1 << k
        bits = f"(CASE WHEN (x & {s}) > 0 THEN 1 ELSE 0 END) AS rx, (CASE WHEN (y & {s}) > 0 THEN 1 ELSE 0 END) AS ry"
        steps.append(f"q{k} AS (SELECT *, {bits} FROM {last})")
        steps.append(f"h{k} AS (SELECT x0, y0, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN 31 - y ELSE y END) ELSE x END AS x, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN 31 - x ELSE x END) ELSE y END AS y, d + {s * s} * xor(3 * rx, ry) AS d FROM q{k})")
        last = f"h{k}"
    return f"WITH {CELLS}, {', '.join(steps)} "


def _cells(spark) -> DataFrame:
    return spark.range(32 * 32).select(F.floor(F.col("id") / 32).alias("x"), (F.col("id") % 32).alias("y"))


@query(_hilbert_sql() + "SELECT x0 AS x, y0 AS y, d FROM h0")
def hilbert_xy2d(spark, sf_dir):
    return _cells(spark).withColumn("d", curves.hilbert_index(F.col("x"), F.col("y"), 32))


@query(_hilbert_sql() + "SELECT d, x0 AS x, y0 AS y FROM h0")
def hilbert_d2xy(spark, sf_dir):
    cells = spark.range(32 * 32).select(F.col("id").alias("d"), curves.hilbert_cell(F.col("id"), 32).alias("c"))
    return cells.select("d", F.col("c.x").alias("x"), F.col("c.y").alias("y"))


@query(f"WITH {CELLS} SELECT x, y, y * 32 + x AS d, x AS back_x, y AS back_y FROM c")
def row_first(spark, sf_dir):
    out = _cells(spark).withColumn("d", curves.row_index(F.col("x"), F.col("y"), 32)).withColumn("c", curves.row_cell(F.col("d"), 32))
    return out.select("x", "y", "d", F.col("c.x").alias("back_x"), F.col("c.y").alias("back_y"))


@query(f"WITH {CELLS} SELECT x, y, x * 32 + y AS d, x AS back_x, y AS back_y FROM c")
def column_first(spark, sf_dir):
    out = _cells(spark).withColumn("d", curves.column_index(F.col("x"), F.col("y"), 32)).withColumn("c", curves.column_cell(F.col("d"), 32))
    return out.select("x", "y", "d", F.col("c.x").alias("back_x"), F.col("c.y").alias("back_y"))


# --- execution -------------------------------------------------------------------


@query(f"WITH RECURSIVE {o.G}, d AS (SELECT src, count(*) AS d FROM g GROUP BY src) SELECT tgt AS id, {o.quant('sum(1.0::DOUBLE / d.d)', 'sum_q')} FROM g JOIN d ON g.src = d.src GROUP BY tgt")
def gather_sum(spark, sf_dir):
    e = g(spark, sf_dir)
    out = e.groupBy("src").agg(F.count("*").alias("d"))
    return algorithms.quantised(e.join(out, "src").groupBy(F.col("tgt").alias("id")).agg(F.sum(1 / F.col("d")).alias("x")), "x", "sum_q")


@query(f"WITH RECURSIVE {o.G} SELECT tgt AS id, min(src) AS least FROM g GROUP BY tgt")
def gather_min(spark, sf_dir):
    return g(spark, sf_dir).groupBy(F.col("tgt").alias("id")).agg(F.min("src").alias("least"))


@query(f"WITH RECURSIVE {o.G} SELECT tgt AS id, min(src + weight) AS least FROM g GROUP BY tgt")
def gather_weighted(spark, sf_dir):
    return g(spark, sf_dir).groupBy(F.col("tgt").alias("id")).agg(F.min(F.col("src") + F.col("weight")).alias("least"))


@query(f"WITH RECURSIVE {o.G}, {o.S}, {o.SSSP_FIX} SELECT x.tgt AS id, min(x.src) AS critical FROM r a JOIN g x ON a.id = x.src JOIN r b ON b.id = x.tgt WHERE a.value + x.weight = b.value GROUP BY x.tgt")
def critical_neighbor(spark, sf_dir):
    e = cut(g(spark, sf_dir))
    return engine.critical(e, algorithms.sssp(e).select("id", F.col("dist").alias("value")), engine.SSSP)


@query(f"""WITH RECURSIVE {o.G}, {o.S}, {o.BFS_FIX} SELECT value + 1 AS iteration, count(*) AS active_vertices, (SELECT count(*) FROM g JOIN r q ON g.src = q.id WHERE q.value = r.value) AS active_edges,
    (SELECT count(*) FROM r q WHERE q.value = r.value + 1) AS changed FROM r GROUP BY value""")
def superstep_stats(spark, sf_dir):
    e = g(spark, sf_dir)
    kept, start = engine.prepared(e), cut(graphs.start_vertex(e))
    out = engine.trace(kept, engine.seeded(start.select("id", F.lit(0).cast("long").alias("value"))), engine.BFS)
    kept.unpersist()
    return out


@query(f"WITH RECURSIVE {o.G}, {o.S}, {o.BFS_FIX} SELECT value AS iteration, count(*) AS changed FROM r WHERE value > 0 GROUP BY value")
def convergence_trace(spark, sf_dir):
    return superstep_stats(spark, sf_dir).where("changed > 0").select("iteration", "changed")


@query(f"WITH RECURSIVE {o.G}, {o.S}, f AS (SELECT tgt AS id FROM g JOIN s ON g.src = s.id) SELECT DISTINCT src // {PER_TILE} AS tile_x, tgt // {PER_TILE} AS tile_y FROM g WHERE src IN (SELECT id FROM f)")
def active_tiles(spark, sf_dir):
    """Tiles that the second round of a search touches."""
    t = cut(_tiled(spark, sf_dir))
    front = t.join(graphs.start_vertex(t).withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("tgt").alias("src")).distinct()
    return t.join(front, "src", "left_semi").select("tile_x", "tile_y").distinct()


@query(f"WITH RECURSIVE {o.G}, {o.S} SELECT x.tgt AS id, count(*) AS n FROM g JOIN s ON g.src = s.id JOIN g x ON x.src = g.tgt GROUP BY x.tgt")
def frontier_expand(spark, sf_dir):
    e = cut(g(spark, sf_dir))
    front = e.join(graphs.start_vertex(e).withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("tgt").alias("src")).distinct()
    return e.join(front, "src").groupBy(F.col("tgt").alias("id")).agg(F.count("*").alias("n"))


@query(TILED + """SELECT tile_x, tile_y, n_edges, CAST(coalesce(sum(n_edges) OVER (ORDER BY tile_x, tile_y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 100 AS BIGINT) AS by_edges,
    (row_number() OVER (ORDER BY tile_x, tile_y) - 1) // 16 AS by_tiles FROM c""")
def tile_batches(spark, sf_dir):
    return tiles.batches(tiles.counts(_tiled(spark, sf_dir)), 100, 16)


@query(TILED + "SELECT tile_x // 4 AS meta_x, tile_y // 4 AS meta_y, count(*) AS tiles_to_run, 16 - count(*) AS tiles_skipped FROM c GROUP BY 1, 2")
def meta_tile_skip(spark, sf_dir):
    t = tiles.counts(_tiled(spark, sf_dir))
    return t.groupBy(F.floor(F.col("tile_x") / 4).alias("meta_x"), F.floor(F.col("tile_y") / 4).alias("meta_y")).agg(F.count("*").alias("tiles_to_run"), (16 - F.count("*")).alias("tiles_skipped"))


@query(GE + "SELECT seq // 500 AS batch_id, CAST(sum(count(*)) OVER (ORDER BY seq // 500) AS BIGINT) AS n_edges, sum(count(*)) OVER (ORDER BY seq // 500) >= 1200 AS runs FROM e GROUP BY 1")
def threshold_start(spark, sf_dir):
    sizes = numbered(spark, sf_dir).groupBy(F.floor(F.col("seq") / 500).alias("batch_id")).agg(F.count("*").alias("n"))
    summed = with_sequence(sizes, "batch_id", running="n")
    return summed.select("batch_id", (F.col("before_n") + F.col("n")).cast("long").alias("n_edges")).withColumn("runs", F.col("n_edges") >= 1200)


@query(f"""WITH RECURSIVE {o.G}, {o.S}, {o.BFS_FIX}, x AS (SELECT (g.src * 31 + g.tgt * 17) % 100 < 5 AS gone, a.value + 1 = b.value AS carries, g.src % {SHARDS} AS shard FROM g LEFT JOIN r a ON a.id = g.src LEFT JOIN r b ON b.id = g.tgt)
    SELECT CAST(shard AS BIGINT) AS shard, count(*) AS deleted, coalesce(bool_or(carries), false) AS restart FROM x WHERE gone GROUP BY shard""")
def reexecution_decision(spark, sf_dir):
    """For each shard, whether its deletions ask for a run from scratch."""
    e = cut(g(spark, sf_dir))
    dist = algorithms.bfs(e)
    gone = mutate.sampled(e, 5).join(dist.select(F.col("id").alias("src"), F.col("dist").alias("a")), "src", "left").join(dist.select(F.col("id").alias("tgt"), F.col("dist").alias("b")), "tgt", "left")
    return gone.groupBy((F.col("src") % SHARDS).alias("shard")).agg(F.count("*").alias("deleted"), F.coalesce(F.bool_or(F.col("a") + 1 == F.col("b")), F.lit(False)).alias("restart"))


@query(f"WITH RECURSIVE {o.G}, {o.V}, {o.fixpoint('SELECT id, id % 1000 AS value FROM v', 'greatest(r.value - 1, 0)', 'max')} SELECT id, value FROM r")
def vertex_program_custom(spark, sf_dir):
    """A user's program: a label that fades by one on each hop; the greatest wins."""
    fading = engine.VertexProgram(lambda v, w, s: F.greatest(v - 1, F.lit(0)), F.max, lambda new, old: new > old)
    kept = engine.prepared(g(spark, sf_dir))
    out = engine.run(kept, engine.seeded(kept.vertices().select("id", (F.col("id") % 1000).alias("value"))), fading)
    kept.unpersist()
    return out.select("id", "value")


# --- algorithms ------------------------------------------------------------------


@query(o.PAGERANK)
def pagerank(spark, sf_dir):
    return algorithms.quantised(algorithms.pagerank(g(spark, sf_dir)), "rank")


@query(o.PAGERANK)
def pagerank_delta(spark, sf_dir):
    return algorithms.quantised(algorithms.pagerank_delta(g(spark, sf_dir)), "rank")


@query(f"WITH RECURSIVE {o.G}, {o.ranks(5)}, {o.ranks(8, name='q')} SELECT a.id, {o.quant('a.rank', 'rank5_q')}, {o.quant('b.rank', 'rank8_q')} FROM p5 a JOIN q8 b ON a.id = b.id")
def pagerank_delta_fused(spark, sf_dir):
    """Two delta programs of 5 and 8 rounds over one kept scan."""
    with kept(g(spark, sf_dir)) as e:
        a, b = (algorithms.quantised(algorithms.pagerank_delta(e, n), "rank", f"rank{n}_q") for n in (5, 8))
    return a.join(b, "id")


@query(o.BFS)
def bfs(spark, sf_dir):
    return algorithms.bfs(g(spark, sf_dir))


@query(o.BFS)
def bfs_async(spark, sf_dir):
    """Two hops in a round."""
    return algorithms.bfs(g(spark, sf_dir), hops=2)


@query(f"WITH RECURSIVE {o.G}, k AS (SELECT id FROM (SELECT src AS id, count(*) AS d FROM g GROUP BY src) ORDER BY d DESC, id LIMIT 3), {o.fixpoint('SELECT id AS start_id, id, CAST(0 AS BIGINT) AS value FROM k', 'r.value + 1', 'min', key='start_id', keyed=False)} SELECT start_id, id, value AS dist FROM r")
def bfs_multi_source(spark, sf_dir):
    e = cut(g(spark, sf_dir))
    return algorithms.bfs_many(e, cut(e.groupBy(F.col("src").alias("id")).count().orderBy(F.desc("count"), "id").limit(3).select("id")))


@query(o.CC)
def cc_directed(spark, sf_dir):
    return algorithms.components(g(spark, sf_dir))


@query(o.CC)
def cc_async(spark, sf_dir):
    return algorithms.components(g(spark, sf_dir), hops=2)


@query(f"WITH RECURSIVE {o.G}, {o.V}, {o.SYM}, {o.fixpoint('SELECT id, id AS value FROM v', 'r.value', 'min', edges='h')} SELECT id, value AS label FROM r")
def cc_undirected(spark, sf_dir):
    return algorithms.components(g(spark, sf_dir), symmetrize=True)


@query(o.SSSP)
def sssp(spark, sf_dir):
    return algorithms.sssp(g(spark, sf_dir))


@query(o.SSSP)
def sssp_async(spark, sf_dir):
    return algorithms.sssp(g(spark, sf_dir), hops=2)


@query(o.SSSP_DELTA)
def sssp_delta(spark, sf_dir):
    """Improvements of at most 1 are not passed on."""
    return algorithms.sssp(g(spark, sf_dir), delta=1.0)


@query(o.SSWP)
def sswp(spark, sf_dir):
    return algorithms.sswp(g(spark, sf_dir))


@query(f"WITH RECURSIVE {o.G}, {o.S}, {o.V}, {o.BFS_FIX}, {o.fixpoint('SELECT id, id AS value FROM v', 'r.value', 'min', name='c')} SELECT c.id, c.value AS label, r.value AS dist FROM c LEFT JOIN r ON c.id = r.id")
def multi_cc_bfs(spark, sf_dir):
    with kept(g(spark, sf_dir)) as e:
        labels, dist = algorithms.components(e), algorithms.bfs(e)
    return labels.join(dist, "id", "left")


@query(f"WITH RECURSIVE {o.G}, {o.S}, {o.BFS_FIX}, {o.fixpoint('SELECT id, CAST(0 AS DOUBLE) AS value FROM s', 'r.value + x.weight', 'min', name='w')} SELECT r.id, r.value AS hops, w.value AS dist FROM r JOIN w ON r.id = w.id")
def multi_job_shared(spark, sf_dir):
    """Two registered jobs over one kept scan."""
    store = jobs.Registry()
    store.add("hops", lambda e: algorithms.bfs(e).withColumnRenamed("dist", "hops"))
    store.add("paths", algorithms.sssp)
    found = store.run_all(g(spark, sf_dir))
    return found["hops"].join(found["paths"], "id")


@query(f"WITH RECURSIVE {o.G}, {o.S}, {o.V}, {o.BFS_FIX}, {o.fixpoint('SELECT id, CAST(0 AS DOUBLE) AS value FROM s', 'r.value + x.weight', 'min', name='w')}, {o.fixpoint('SELECT id, id AS value FROM v', 'r.value', 'min', name='c')} SELECT r.id, r.value AS hops, w.value AS dist, c.value AS label FROM r JOIN w ON r.id = w.id JOIN c ON r.id = c.id")
def scheduled_jobs(spark, sf_dir):
    """Three jobs in groups by the share of the machine that they are known to take: two together, the third after them."""
    todo = [
        jobs.Job("hops", "g_dense", lambda e: algorithms.bfs(e).withColumnRenamed("dist", "hops"), cpu=40.0),
        jobs.Job("paths", "g_dense", algorithms.sssp, cpu=55.0), jobs.Job("labels", "g_dense", algorithms.components, cpu=70.0),
    ]
    found = jobs.run_groups(spark, jobs.admitted(todo), {"g_dense": g(spark, sf_dir)})
    return found["hops"].join(found["paths"], "id").join(found["labels"], "id")


CONFIGURED = "b AS MATERIALIZED (SELECT *, seq // 30000 AS batch, (src * 31 + tgt * 17) % 100 AS h FROM e), k AS (SELECT DISTINCT batch AS k FROM b), le AS MATERIALIZED (SELECT k AS batch_id, src, tgt, weight FROM b JOIN k ON b.batch <= k AND NOT (h < 1 AND b.batch <= k - 1))"


@query(f"WITH RECURSIVE {o.G}, {o.E}, {CONFIGURED}, {o.fixpoint(o.LABELS, 'r.value', 'min', 'le', 'batch_id')} SELECT batch_id, id, CAST(value AS DOUBLE) AS value FROM r")
def configured_run(spark, sf_dir):
    """Components by options: batches of 30,000 edges that delete a hundredth of the batch before, with edge log and snapshots."""
    config = jobs.EngineConfig(algorithm="cc", batch_edges=30_000, deletion_percent=1, write_log=True, write_results=True, vertices_per_tile=PER_TILE)
    return jobs.execute(spark, sf_dir, config, scratch_path(spark, "run"))


# --- evolving --------------------------------------------------------------------


def _batches(spark, sf_dir) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """Live edges, deletions and inserts of four batches; each batch deletes some edges of the batch before."""
    e = cut(numbered(spark, sf_dir))
    n = e.count()
    e = e.select("src", "tgt", "weight", F.floor(F.col("seq") * 4 / n).alias("batch"), ((F.col("src") * 31 + F.col("tgt") * 17) % 100 < 2).alias("goes"))
    gone = lambda k: e.where((F.col("batch") == k - 1) & F.col("goes"))
    return [(e.where((F.col("batch") <= k) & ~(F.col("goes") & (F.col("batch") <= k - 1))), gone(k), e.where(F.col("batch") == k)) for k in range(4)]


def _from_start(spark, sf_dir, value, program, column, kind) -> DataFrame:
    start = cut(graphs.start_vertex(g(spark, sf_dir))).select("id", F.lit(value).alias("value"))
    return incremental.stacked(incremental.evolve(_batches(spark, sf_dir), lambda live: start, program), column, kind)


@query(o.evolving(o.STARTS.format("0 AS BIGINT"), "r.value + 1", "min", "dist"))
def evolving_bfs(spark, sf_dir):
    return _from_start(spark, sf_dir, 0, engine.BFS, "dist", "long")


@query(o.evolving(o.STARTS.format("0 AS DOUBLE"), "r.value + x.weight", "min", "dist"))
def evolving_sssp(spark, sf_dir):
    return _from_start(spark, sf_dir, 0.0, engine.SSSP, "dist", "double")


@query(o.evolving(o.STARTS.format("'infinity' AS DOUBLE"), "least(r.value, x.weight)", "max", "width", "WHERE value < 'infinity'::DOUBLE"))
def evolving_sswp(spark, sf_dir):
    return _from_start(spark, sf_dir, float("inf"), engine.SSWP, "width", "double").where(F.col("width") < float("inf"))


@query(o.evolving(o.LABELS, "r.value", "min", "label"))
def evolving_cc(spark, sf_dir):
    labels = lambda live: graphs.vertices(live).select("id", F.col("id").alias("value"))
    return incremental.stacked(incremental.evolve(_batches(spark, sf_dir), labels, engine.CC, labels), "label", "long")


def _evolving_ranks_sql() -> str:
    parts = [f"l{k} AS MATERIALIZED (SELECT src, tgt FROM le WHERE batch_id = {k}), {o.ranks(5, f'l{k}', f'p{k}_')}" for k in range(4)]
    return f"WITH RECURSIVE {o.G}, {o.E}, {o.LOG}, {o.LIVE}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS batch_id, id, {o.quant('rank')} FROM p{k}_5" for k in range(4))


@query(_evolving_ranks_sql())
def evolving_pagerank(spark, sf_dir):
    """Ranks of a fixed number of rounds on the live edges of each batch."""
    parts = [algorithms.quantised(algorithms.pagerank(live, 5), "rank").select(F.lit(k).cast("long").alias("batch_id"), "id", "rank_q") for k, (live, *_) in enumerate(_batches(spark, sf_dir))]
    return reduce(DataFrame.unionByName, parts)


@query()
def evolving_pagerank_residual(spark, sf_dir):
    """Ranks carried from batch to batch by residuals, to a tolerance; thousandths."""
    found = incremental.evolve_ranks(_batches(spark, sf_dir), 1e-5)
    parts = [f.select(F.lit(k).cast("long").alias("batch_id"), "id", F.round("rank", 3).alias("rank")) for k, f in enumerate(found)]
    return reduce(DataFrame.unionByName, parts)


STATIC = f"WITH RECURSIVE {o.G}, {o.S}, {o.V}, h AS MATERIALIZED ({o.MULTIGRAPH}), "


def _static(spark, sf_dir, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, before, after: an algorithm on the final graph with its parallel edges, and once more when it is compacted."""
    e = cut(graphs.multigraph(table(spark, sf_dir, "lineitem")))
    a, b = (run(x).toDF("id", name) for x, name in ((e, "before"), (mutate.compact(e), "after")))
    return a.join(b, "id", "full")


@query(STATIC + f"{o.CC_FIX}, {o.fixpoint('SELECT id, id AS value FROM v', 'r.value', 'min', edges='h', name='b')} SELECT r.id, b.value AS before, r.value AS after FROM r JOIN b ON r.id = b.id")
def static_cc(spark, sf_dir):
    return _static(spark, sf_dir, algorithms.components)


@query(STATIC + f"{o.SSSP_FIX}, {o.fixpoint('SELECT id, CAST(0 AS DOUBLE) AS value FROM s', 'r.value + x.weight', 'min', edges='h', name='b')} SELECT r.id, b.value AS before, r.value AS after FROM r JOIN b ON r.id = b.id")
def static_sssp(spark, sf_dir):
    start = cut(graphs.start_vertex(g(spark, sf_dir)))
    return _static(spark, sf_dir, lambda e: algorithms.sssp(e, start))


@query(f"WITH RECURSIVE {o.G}, {o.E}, {o.LOG}, {o.LIVE} SELECT batch_id, count(*) AS n_edges FROM le GROUP BY 1")
def evolving_edges(spark, sf_dir):
    """Sizes of the live edge set after each batch, from one change log."""
    e = cut(numbered(spark, sf_dir))
    n = e.count()
    e = e.withColumn("batch_id", F.floor(F.col("seq") * 4 / n))
    gone = e.where((F.col("src") * 31 + F.col("tgt") * 17) % 100 < 2).select((F.col("seq") + n).alias("seq"), (F.col("batch_id") + 1).alias("batch_id"), F.lit("D").alias("op"), "src", "tgt", "weight")
    log = cut(e.select("seq", "batch_id", F.lit("I").alias("op"), "src", "tgt", "weight").unionByName(gone))
    return reduce(DataFrame.unionAll, [mutate.live(log, k).agg(F.lit(k).cast("long").alias("batch_id"), F.count("*").alias("n_edges")) for k in range(4)])


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS tgt, CASE WHEN event_type = 'error' THEN 'D' ELSE 'I' END AS op FROM events),
    c AS (SELECT src, tgt, op, seq FROM e WHERE tgt IS NOT NULL) SELECT src, tgt FROM c GROUP BY src, tgt HAVING arg_max(op, seq) = 'I'""")
def streaming_live_edges(spark, sf_dir):
    """Events as edge changes, streamed from files; the live set after the last micro-batch."""
    seq = with_sequence(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type"), "ts", "event_id")
    after = seq.select((F.col("seq") - 1).alias("seq"), F.col("user_id").alias("tgt"))
    op = F.when(F.col("event_type") == "error", "D").otherwise("I")
    changes = seq.join(after, "seq").select("seq", F.floor(F.col("seq") / 5000).alias("batch_id"), op.alias("op"), F.col("user_id").alias("src"), "tgt", F.col("value").alias("weight"))
    source, log = scratch_path(spark, "changes"), scratch_path(spark, "log")
    changes.repartitionByRange(3, "seq").write.parquet(source)
    runner.ingest(spark, source, log, scratch_path(spark, "stream"))
    return mutate.live(spark.read.parquet(log), 1 << 62).select("src", "tgt")


# --- results ---------------------------------------------------------------------


def _ranks(spark, sf_dir, rounds=10) -> DataFrame:
    """Ranks cut to whole millionths, so that both engines order them alike."""
    return algorithms.quantised(algorithms.pagerank(g(spark, sf_dir), rounds), "rank", "rank_q")


@query(f"WITH RECURSIVE {o.G}, {o.ranks()}, q AS (SELECT id, {o.quant('rank')} FROM p10) SELECT id, rank_q, CAST(row_number() OVER (ORDER BY rank_q DESC, id) AS INTEGER) AS rank FROM q WHERE rank_q > 150000")
def sort_results(spark, sf_dir):
    """All ranks but those of vertices without in-edges, best first."""
    return with_sequence(_ranks(spark, sf_dir).where("rank_q > 150000").withColumn("down", -F.col("rank_q")), "down", "id", name="at").select("id", "rank_q", (F.col("at") + 1).cast("int").alias("rank"))


TOP = f"WITH RECURSIVE {o.G}, {o.ranks()}, {o.ranks(3, name='q')}, a AS (SELECT id, {o.quant('rank', 'x')} FROM p10), b AS (SELECT id, {o.quant('rank', 'x')} FROM q3), ta AS (SELECT id, x, CAST(row_number() OVER (ORDER BY x DESC, id) AS INTEGER) AS rank FROM a QUALIFY rank <= 100), tb AS (SELECT id, x, CAST(row_number() OVER (ORDER BY x DESC, id) AS INTEGER) AS rank FROM b QUALIFY rank <= 100) "


def _tops(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a, b = (cut(post.top_k(_ranks(spark, sf_dir, n), "rank_q", 100)) for n in (10, 3))
    return a, b


@query(TOP + "SELECT id, x AS rank_q, rank FROM ta")
def top_k(spark, sf_dir):
    return post.top_k(_ranks(spark, sf_dir), "rank_q", 100)


@query(TOP + "SELECT rank, ta.id AS id_a, tb.id AS id_b FROM ta JOIN tb USING (rank)")
def rank_pairs(spark, sf_dir):
    return post.paired(*_tops(spark, sf_dir))


@query(TOP + "SELECT count(*) AS n_common, CAST(coalesce(sum(abs(ta.rank - tb.rank)), 0) AS BIGINT) AS footrule FROM ta JOIN tb ON ta.id = tb.id")
def rank_footrule(spark, sf_dir):
    return post.footrule(*_tops(spark, sf_dir))


def _tau_sql(rows: str, pair: str = "a.rank < b.rank", by: str = "") -> str:
    """Concordant and discordant pairs of ``rows`` (rank, x, y), quality (tau + 1) / 2 and p-value by the normal approximation."""
    z = "abs(3 * (concordant - discordant) / sqrt(n * (n - 1) * (2 * n + 5) / 2))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {z} / sqrt(2)))"
    p = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-{z} * {z} / 2)"
    k, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    on = f" AND a.{by} = b.{by}" if by else ""
    return f"""s AS (SELECT {f'a.{by}, ' if by else ''}sign(a.x - b.x) * sign(a.y - b.y) AS s FROM {rows} a JOIN {rows} b ON {pair}{on}),
        c AS (SELECT {k}CAST(count(*) FILTER (s > 0) AS DOUBLE) AS concordant, CAST(count(*) FILTER (s < 0) AS DOUBLE) AS discordant, count(*) AS pairs, round((1 + sqrt(1 + 8 * count(*))) / 2) AS n FROM s{group})
        SELECT {k}CAST(concordant AS BIGINT) AS concordant, CAST(discordant AS BIGINT) AS discordant, {o.quant('((concordant - discordant) / pairs::DOUBLE + 1) / 2', 'quality_q')}, {o.quant(p, 'p_q')} FROM c"""


@query(TOP + ", p AS (SELECT rank, ta.id AS x, tb.id AS y FROM ta JOIN tb USING (rank)), " + _tau_sql("p"))
def kendall_tau(spark, sf_dir):
    """Of the two lists of ids, place by place."""
    return post.kendall(post.paired(*_tops(spark, sf_dir)), "id_a", "id_b")


@query(TOP + ", p AS (SELECT ta.rank AS rank, ta.rank AS x, tb.rank AS y FROM ta JOIN tb ON ta.id = tb.id), " + _tau_sql("p"))
def kendall_tau_ranks(spark, sf_dir):
    """Of the ranks that the two lists give to the ids that both have."""
    a, b = _tops(spark, sf_dir)
    both = a.select("id", "rank").join(b.select("id", F.col("rank").alias("rank_b")), "id")
    return post.kendall(both.select("rank", F.col("rank").alias("rank_a"), "rank_b"), "rank_a", "rank_b")


#: The thresholds of the sweep.
DELTAS = (0.00, 0.0025, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64)
EVENTS = """SELECT src, tgt, min(weight) AS weight FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS tgt, value AS weight FROM events) t
    WHERE tgt IS NOT NULL AND src <> tgt GROUP BY src, tgt"""


def _sweep_sql() -> str:
    one = []
    for name, graph in (("g_dense", "g"), ("g_events", "w")):
        best = lambda of, x, k="": f"SELECT {k}id, row_number() OVER ({f'PARTITION BY {k[:-2]} ' if k else ''}ORDER BY floor({x} * 1e6 + 0.3137) DESC, id) AS place FROM {of} QUALIFY place <= 100"
        one.append(f"SELECT '{name}' AS graph, * FROM (WITH {o.ranks(10, graph, 'p')}, {o.delta_ranks(graph, DELTAS, 'q')}, ta AS ({best('p10', 'rank')}), tb AS ({best('q10', 'rank', 'delta, ')}), x AS (SELECT delta, place AS rank, ta.id AS x, tb.id AS y FROM ta JOIN tb USING (place)), {_tau_sql('x', by='delta')})")
    return f"WITH {o.G}, w AS MATERIALIZED ({EVENTS}) " + " UNION ALL ".join(one)


@query(_sweep_sql())
def delta_sweep(spark, sf_dir):
    """Quality of delta-PageRank's order against PageRank's, for ten thresholds on two graphs."""
    parts = []
    for name, graph in (("g_dense", g), ("g_events", g_events)):
        with kept(graph(spark, sf_dir)) as e:
            exact = cut(post.top_k(algorithms.quantised(algorithms.pagerank(e), "rank"), "rank_q", 100))
            found = algorithms.quantised(algorithms.pagerank_deltas(e, DELTAS), "rank")
        for delta in DELTAS:
            best = post.top_k(found.where(F.col("delta") == delta).drop("delta"), "rank_q", 100)
            tau = post.kendall(post.paired(exact, best), "id_a", "id_b")
            parts.append(tau.select(F.lit(name).alias("graph"), F.lit(delta).alias("delta"), *tau.columns))
    return reduce(DataFrame.unionAll, parts)


@query(f"WITH RECURSIVE {o.G}, {o.ranks()}, {o.ranks(8, name='q')}, a AS (SELECT id, {o.quant('rank')} FROM p10), b AS (SELECT id, {o.quant('rank')} FROM q8) SELECT count(*) AS n, CAST(sum(CASE WHEN a.rank_q // 100 = b.rank_q // 100 THEN 0 ELSE 1 END) AS BIGINT) AS n_different FROM a JOIN b ON a.id = b.id")
def compare_ranks(spark, sf_dir):
    a, b = (_ranks(spark, sf_dir, n).select("id", (F.col("rank_q") / 1e6).alias("rank")) for n in (10, 8))
    return post.compare_ranks(a, b)


@query(f"WITH RECURSIVE {o.G}, {o.ranks(4)}, x AS (SELECT id, {', '.join(o.quant(f'p{k}.rank', f'q{k}') for k in (2, 3, 4))} FROM p2 JOIN p3 USING (id) JOIN p4 USING (id)), y AS (SELECT CAST(k AS BIGINT) AS iteration, CASE k WHEN 2 THEN q2 ELSE q3 END AS a, CASE k WHEN 2 THEN q3 ELSE q4 END AS b FROM x, range(2, 4) t(k)) SELECT iteration, count(*) AS n, CAST(sum(CASE WHEN abs(a - b) * 10000 <= greatest(abs(a), abs(b)) THEN 0 ELSE 1 END) AS BIGINT) AS n_different FROM y GROUP BY 1")
def compare_snapshots(spark, sf_dir):
    """Each of two iterations against the next one."""
    by = {n: cut(_ranks(spark, sf_dir, n)) for n in (2, 3, 4)}
    at = lambda n, k: by[n].select(F.lit(k).cast("long").alias("iteration"), "id", (F.col("rank_q") * 10000).alias("rank"))
    return post.compare_snapshots(at(2, 2).unionAll(at(3, 3)), at(3, 2).unionAll(at(4, 3)))


@query(f"WITH RECURSIVE {o.G}, {o.V}, {o.CC_FIX}, {o.SYM}, {o.fixpoint('SELECT id, id AS value FROM v', 'r.value', 'min', edges='h', name='u')} SELECT count(*) AS n, CAST(sum(CASE WHEN a.value = b.value THEN 0 ELSE 1 END) AS BIGINT) AS n_different, count(DISTINCT a.value) AS labels_a, count(DISTINCT b.value) AS labels_b FROM r a JOIN u b ON a.id = b.id")
def compare_labels(spark, sf_dir):
    with kept(g(spark, sf_dir)) as e:
        directed, weak = algorithms.components(e), algorithms.components(e, symmetrize=True)
    return post.compare_labels(directed, weak)


@query(f"WITH RECURSIVE {o.G}, {o.V}, {o.SYM}, {o.fixpoint('SELECT id, id AS value FROM v', 'r.value', 'min', edges='h')} SELECT id, value AS label FROM r")
def canonical_labels(spark, sf_dir):
    """Weak components under other labels, brought back to their least members."""
    e = g(spark, sf_dir)
    return post.canonical(algorithms.components(e, symmetrize=True).select("id", (F.col("label") + 1_000_000).alias("label")))


@query(TILED + f"SELECT min(n_edges) AS least, max(n_edges) AS most, median(n_edges) AS median, {o.quant('avg(n_edges)', 'mean_q')}, {o.quant('stddev_pop(n_edges)', 'stddev_q')} FROM c")
def size_stats(spark, sf_dir):
    return post.size_stats(tiles.counts(_tiled(spark, sf_dir)), "n_edges")


@query("""WITH c AS (SELECT event_type, user_id // 10 AS slot, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, slot, n, n - coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY slot), 0) AS delta FROM c""")
def interval_deltas(spark, sf_dir):
    counters = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("user_id") / 10).alias("slot")).agg(F.count("*").alias("n"))
    return post.interval_deltas(counters, "event_type", "slot", "n")


# --- helpers ---------------------------------------------------------------------


def _mix32(x: str) -> str:
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = f"(xor({x}, {x} >> {shift}) * {factor}::UBIGINT % {1 << 32}::UBIGINT)"
    return f"xor({x}, {x} >> 16)"


@query(f"""WITH i AS (SELECT id, CAST(id AS UBIGINT) AS u FROM range(0, 1000) t(id)), h AS (SELECT id, {o.mix64('u')} AS h, {_mix32('u')} AS h32 FROM i)
    SELECT id, CAST(CASE WHEN h >= {1 << 63}::UBIGINT THEN CAST(h AS HUGEINT) - {1 << 64}::HUGEINT ELSE CAST(h AS HUGEINT) END AS BIGINT) AS h64, CAST(h32 AS BIGINT) AS h32, {o.unit('h')} AS u FROM h""")
def hash_functions(spark, sf_dir):
    return spark.range(1000).select("id", scalars.hash64("id").alias("h64"), scalars.hash32("id").alias("h32"), scalars.hash_unit("id").alias("u"))


@query("""SELECT x, CAST(ceil(log2(x)) AS BIGINT) AS up, CAST(pow(2, ceil(log2(x))) AS BIGINT) AS next, CAST(pow(2, floor(log2(x))) AS BIGINT) AS previous, (x + 15) // 16 * 16 AS rounded FROM range(1, 1001) t(x)""")
def power_of_two_helpers(spark, sf_dir):
    x = F.col("x")
    return spark.range(1, 1001).withColumnRenamed("id", "x").select("x", scalars.log2_up(x).alias("up"), scalars.next_power(x).alias("next"), scalars.previous_power(x).cast("long").alias("previous"), scalars.round_up(x, 16).alias("rounded"))
