"""Exact top-k inner products by vector-approximation files.

Vectors become whole numbers floor(scale * x) and are written once, each with a row
number. The VA-file holds blocks of rows of like length where they lie: one byte for
each component, the number of its cell between the least and greatest value that the
component takes in the block.

* scan: the cells alone give bounds of every score, as the product of the query with the
  cells' centres, less and plus the query's reach over half a cell. A task streams its
  blocks past the queries and keeps the rows whose upper bound is not below the kth
  greatest lower bound so far; over all tasks, those at or above the kth greatest lower
  bound are candidates.
* refine: exact vectors are read by row number, the candidates of greatest upper bound
  first, in steps that double, until no unread candidate's bound reaches the kth exact
  score.

Exact vectors move for candidates only. Queries go to the executors in chunks of bounded
bytes; no pair of a query and a row is ever a row of a table unless it is a candidate.

Defined cases: vectors that are null or hold null or non-finite components take no
part, as do null ids; shorter vectors count as padded with zeros; a component of 2**63
or more after scaling, or a candidate's score that no long holds, is an error;
repeated ids count each, but a query never meets its own id; ties go to the smaller id;
rows that repeat a query's id ask once, with the least of their vectors; an empty table
gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, sized_join, stored

CELLS = 256
#: Cells of a block, and bytes of the queries that are sent to the executors at once.
BLOCK_BYTES, QUERY_BYTES = 1 << 19, 16 << 20
#: Queries that meet a block together.
TOGETHER = 256
LIMIT = float(1 << 63)

FOUND = "query_id long, row long, vec_id long, low double, high double"


def whole(embedding: Column, scale: int) -> Column:
    far = F.raise_error(F.lit("a component is too large for 64 bits after scaling")).cast("long")
    x = F.transform(embedding, lambda v: F.when(F.abs(v.cast("double") * scale) >= LIMIT, far).otherwise(F.floor(v.cast("double") * scale)))
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, x)


def usable(df: DataFrame, scale: int) -> DataFrame:
    """row, vec_id, v (whole numbers) of the vectors that take part."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    real = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return real.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale).alias("v"))


def _padded(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones padded with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(size.max(initial=0)) if width is None else width), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value and cell width of each component, and the cells. Differences are taken without sign: they fit 64 bits whatever the values."""
    low = v.min(axis=0)
    above = v.view(np.uint64) - low.view(np.uint64)
    step = above.max(axis=0) // np.uint64(CELLS) + np.uint64(1)
    return low, step, (above // step).astype(np.uint8)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (row_numbers, ids, low, step, cells) of rows (row, vec_id, v), by powers of two of their length."""
    names = ["row_numbers", "ids", "low", "step", "cells"]

    def block(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        width = max(p[2].shape[1] for p in parts)
        v = np.concatenate([np.pad(p[2], ((0, 0), (0, width - p[2].shape[1]))) for p in parts])
        data = [np.concatenate([p[c] for p in parts]) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (*data, *quantised(v))], names)

    held: dict[int, list] = {}
    for batch in batches:
        rows, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        size = np.diff(batch.column(2).offsets.to_numpy())
        kind = np.ceil(np.log2(np.maximum(size, 16))).astype(int)
        for k in np.unique(kind).tolist():
            most = max(1, BLOCK_BYTES >> k)
            at = np.flatnonzero(kind == k)
            for i in range(0, len(at), most):
                some = at[i : i + most]
                held.setdefault(k, []).append((rows[some], ids[some], _padded(batch.column(2).take(pa.array(some)))))
                if sum(len(p[0]) for p in held[k]) >= most:
                    yield block(held.pop(k))
    for parts in held.values():
        yield block(parts)


def bounds(q: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the possible scores of each (query, row) and the reach of each query around them, rounding errors included."""
    d = min(q.shape[1], len(low))
    q, start, width = q[:, :d].astype(float), low[:d].astype(float), step[:d].astype(float)
    half = (width - 1) / 2
    centres = q @ (start + half + cells[:, :d] * width).T
    size = np.abs(q) @ (np.abs(start) + CELLS * width)
    return centres, np.abs(q) @ half + size * (d + 8) * 2.0**-50


class Candidates:
    """Rows that may be among the k best of the queries, by place of the query."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.rows: list[tuple[np.ndarray, ...]] = []  # query, row, vec_id, low, high
        self.kept = self.fresh = 0

    def add(self, *rows: np.ndarray) -> None:
        self.rows.append(rows)
        self.fresh += len(rows[0])
        if self.fresh > 4 * self.kept + 100_000:
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        """Raises the kth lower bounds and drops what lies below them."""
        if not self.rows:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, float))
        q, row, ids, low, high = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((-low, q))
        nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        kth = order[nth == self.k - 1]
        self.floor[q[kth]] = np.maximum(self.floor[q[kth]], low[kth])
        keep = high >= self.floor[q]
        out = tuple(c[keep] for c in (q, row, ids, low, high))
        self.rows, self.kept, self.fresh = [out], int(keep.sum()), 0
        return out


def _scan(sent, k: int):
    """Candidates of the sent queries among the blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = sent.value
        found = Candidates(len(q_ids), k)
        for batch in batches:
            for rows, ids, low, step, cells in zip(*(c.to_pylist() for c in batch.columns)):
                rows, ids, low, step = (np.frombuffer(x, t) for x, t in ((rows, np.int64), (ids, np.int64), (low, np.int64), (step, np.uint64)))
                cells = np.frombuffer(cells, np.uint8).reshape(len(rows), len(low))
                at = np.minimum(np.searchsorted(q_ids, ids), len(q_ids) - 1)
                own = np.flatnonzero(q_ids[at] == ids)
                for a in range(0, len(q_ids), TOGETHER):
                    b = min(a + TOGETHER, len(q_ids))
                    centres, reach = bounds(q[a:b], low, step, cells)
                    mine = own[(at[own] >= a) & (at[own] < b)]
                    centres[at[mine] - a, mine] = -np.inf  # a query does not meet its own id
                    floor = found.floor[a:b]
                    if len(rows) > k and np.isneginf(floor).any():
                        floor = np.maximum(floor, np.partition(centres, len(rows) - k, axis=1)[:, len(rows) - k] - reach)
                    i, j = np.nonzero((centres + reach[:, None] >= floor[:, None]) & (centres > -np.inf))
                    found.add(i + a, rows[j], ids[j], centres[i, j] - reach[i], centres[i, j] + reach[i])
        at, *rest = found.prune()
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in (q_ids[at], *rest)], [f.split()[0] for f in FOUND.split(", ")])

    return run


def _score(sent):
    """query_id, vec_id, score of rows (query_id, vec_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = sent.value
        for batch in batches:
            v = _padded(batch.column(2))
            d = min(v.shape[1], q.shape[1])
            mine = q[np.searchsorted(q_ids, batch.column(0).to_numpy(zero_copy_only=False))][:, :d]
            v = v[:, :d]
            large = (np.abs(mine.astype(float)) * np.abs(v.astype(float))).sum(axis=1) >= 2.0**62
            scores = np.where(large[:, None], 0, mine * np.where(large[:, None], 0, v)).sum(axis=1).tolist()
            for i in np.flatnonzero(large).tolist():
                scores[i] = sum(x * y for x, y in zip(mine[i].tolist(), v[i].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _refined(base: DataFrame, candidates: DataFrame, sent, k: int) -> DataFrame:
    """The k best (query_id, vec_id, score, rank) of ``candidates`` (query_id, row, high), read in the order of their bounds."""
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), "row")
    ranked = stored(candidates.select("query_id", "row", "high", F.row_number().over(order).alias("nth")), "candidates")
    best, done, step = None, 0, 4 * k
    unread = ranked
    while True:
        some = stored(unread.where((F.col("nth") > done) & (F.col("nth") <= done + step)).select("query_id", "row"), "asked-rows")
        exact = sized_join(base, some, "row", "inner").select("query_id", "vec_id", "v").mapInArrow(_score(sent), "query_id long, vec_id long, score long")
        before, best = best, stored(_best(exact if best is None else best.drop("rank").unionByName(exact), k), "best")
        forget(some, before)
        done, step = done + step, 2 * step
        kth = best.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
        rest = ranked.where(F.col("nth") > done).join(kth, "query_id", "left")
        # doubles of long scores are rounded: unread bounds must lie below them by more than that
        unread = rest.where(F.col("kth").isNull() | (F.col("high") >= F.col("kth") - F.abs("kth") * 2.0**-52)).select("query_id", "row", "high", "nth")
        if unread.isEmpty():
            forget(ranked)
            return best


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` best other vectors of each query."""
    spark = vectors.sparkSession
    base = stored(usable(vectors, scale), "vectors")
    asked = stored(base.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    facts = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims")).first()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts["n"]:
        return out
    file = stored(base.mapInArrow(_blocks, "row_numbers binary, ids binary, low binary, step binary, cells binary"), "va-file")
    chunks = -(-facts["n"] * max(facts["dims"], 1) * 8 // QUERY_BYTES)
    for c in range(chunks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).orderBy("vec_id").toArrow()  # about QUERY_BYTES
        if not mine.num_rows:
            continue
        ids = mine.column(0).to_numpy()
        sent = spark.sparkContext.broadcast((ids, _padded(mine.column(1).combine_chunks())))
        found = stored(file.mapInArrow(_scan(sent, k), FOUND), "bounds")
        low = Window.partitionBy("query_id").orderBy(F.desc("low"))
        kth = found.withColumn("nth", F.row_number().over(low)).where(F.col("nth") == k).select("query_id", F.col("low").alias("floor"))
        able = found.join(kth, "query_id", "left").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
        out = out.unionByName(_refined(base, able, sent, k))
        forget(found)
    forget(asked, file, base)
    return out
