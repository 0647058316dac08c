"""Best-fit packing of token sequences, in bulk-synchronous supersteps.

Documents are tokenised where they lie, cut into pieces of at most ``capacity``
tokens and written once. Supersteps go through bands of lengths, the longest first:

* range sort: the band's pieces and all gaps are range-partitioned and sorted by size;
* deal: pieces and gaps go to shards by their rank, in turn, so that every shard has an
  even sample of all sizes and no gap is offered in two shards;
* successor sweep: each shard goes through its pieces, the longest first, and gives each
  the smallest gap that holds it. Pieces that want the same gap are in one shard, where
  the first in rank takes it and the next one goes on to the next successor;
* update: what is left of a gap is a gap again, in the sweep and for the next band.
  Pieces whose shard has no gap for them are dealt once more with all gaps that are
  left, and only then open new sequences.

With one shard this is best-fit decreasing, piece by piece. A shard holds about SHARD
rows, so tasks stay small whatever the number of documents; the driver sees counts.

Defined cases: a null or empty text is the end id alone; null ids are kept;
repeated rows are packed each; an empty table gives no rows; a text of any length
is cut whole; pieces of equal length are ranked by where they lie; extra columns of
the input are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, forget, stored

CAPACITY = 2048
#: Words whose ids a worker keeps; beyond it the store starts anew.
CACHE_WORDS = 600_000

#: Pieces and gaps of a shard.
SHARD = 8192
#: Each band of lengths reaches down to this part of its upper end.
BAND = 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"
SWEPT = f"{PIECES}, sequence_id long, offset long, gap long"


class WordCache:
    """Ids of texts by way of their space-separated chunks, which the tokenizer treats independently.

    Most chunks are a Latin word with ASCII punctuation behind it: new words of
    that kind are encoded together in one text and told apart by the end-of-word
    mark of their last tokens. All others are encoded alone.
    """

    SIMPLE = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.chunks: dict[str, bytes] = {"": b""}  # a word and its punctuation are chunks too

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_words(self, words: list[str]) -> None:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(words) and stops[-1] == len(ids):
            data, at = ids.tobytes(), 0
            for w, stop in zip(words, (stops * 4).tolist()):
                self.chunks[w] = data[at:stop]
                at = stop
        else:
            self.chunks.update((w, self.one(w)) for w in words)

    def learn(self, new: set[str]) -> None:
        if len(self.chunks) + len(new) > CACHE_WORDS:
            self.chunks = {"": b""}
        split, words = {}, set()
        for w in new:
            if m := self.SIMPLE.fullmatch(w.lower()):
                split[w] = m
                if m[1] not in self.chunks:
                    words.add(m[1])
            else:
                self.chunks[w] = self.one(w)
        ordered = list(words)
        for i in range(0, len(ordered), 2000):
            self.learn_words(ordered[i : i + 2000])
        for w, m in split.items():
            if m[2] not in self.chunks:
                self.chunks[m[2]] = self.one(m[2])
            self.chunks[w] = self.chunks[m[1]] + self.chunks[m[2]]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        out = []
        for words in split:
            unknown = set(words).difference(self.chunks)
            if len(unknown) > CACHE_WORDS // 4:  # one enormous text: encode it as it is
                out.append(self.one(" ".join(words)))
                continue
            if unknown:
                self.learn(unknown | (set(words) if len(self.chunks) + len(unknown) > CACHE_WORDS else set()))
            out.append(b"".join(map(self.chunks.__getitem__, words)))
        return out


_caches: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """One store for each worker, used by all its tasks."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of each (doc_id, text); ``place``, which tells them apart, is the task and the number in it."""
    stop = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, place = word_cache(tokenizer_path), TaskContext.get().partitionId() << 33
        for batch in few_rows(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = cache.ids([text or ""])[0] + stop
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), place))
                    place += 1
            yield _columns(rows, PIECES)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


_ARROW = {"long": pa.int64(), "int": pa.int32()}


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], list(names))


class Shard:
    """Gaps by size, and the sweep of pieces over them."""

    def __init__(self, capacity: int, first_id: int | None):
        self.capacity, self.next_id = capacity, first_id
        self.gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.sizes = 0  # bit g: there is a gap of size g

    def add(self, gap: int, sequence: int) -> None:
        self.gaps[gap].append(sequence)
        self.sizes |= 1 << gap

    def place(self, length: int) -> tuple[int | None, int | None]:
        """Sequence and offset in the smallest gap that holds ``length``; a new sequence's where there is none, if the shard may open one."""
        if fit := self.sizes >> length:
            gap = length + (fit & -fit).bit_length() - 1
            sequence = self.gaps[gap].pop()
            if not self.gaps[gap]:
                self.sizes ^= 1 << gap
        elif self.next_id is None:
            return None, None
        else:
            gap, sequence = self.capacity, self.next_id
            self.next_id += 1
        if gap > length:
            self.add(gap - length, sequence)
        return sequence, self.capacity - gap

    def left(self) -> list[tuple]:
        """Rows of SWEPT for the gaps that are left."""
        return [(None,) * 6 + (s, None, g) for g, some in enumerate(self.gaps) for s in some]


def _sweep(capacity: int, step: int, opens: bool):
    """Rows of SWEPT from rows (shard, size, PIECES, sequence_id), sorted by shard, gaps before pieces, the longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            number, size, sequence = (batch.column(c).to_pylist() for c in (0, 1, 8))
            found, rows = [], []
            for k, n, gap_of in zip(number, size, sequence):
                if k != now:
                    rows += shard.left() if shard else []
                    # numbers of new sequences: superstep, shard, count
                    now, shard = k, Shard(capacity, (step << 48) + (k << 24) if opens else None)
                if gap_of is None:
                    found.append(shard.place(n))
                else:
                    shard.add(n, gap_of)
            pieces = batch.filter(pa.array([x is None for x in sequence], pa.bool_()))
            at = [pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))]
            yield pa.RecordBatch.from_arrays([*pieces.columns[2:8], *at, pa.nulls(len(found), pa.int64())], [f.split()[0] for f in SWEPT.split(", ")])
            if rows:
                yield _columns(rows, SWEPT)
        if shard:
            yield _columns(shard.left(), SWEPT)

    return run


def swept(pieces: DataFrame, gaps: DataFrame | None, shards: int, step: int, opens: bool, capacity: int) -> DataFrame:
    """One superstep over ``pieces`` (PIECES) and ``gaps`` (sequence_id, gap): rows of SWEPT, placed pieces, pieces without a place and gaps."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    rows = pieces.select(F.col("length").alias("size"), *names, F.lit(None).cast("long").alias("sequence_id"))
    if gaps is not None:
        none = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in PIECES.split(", ")]
        rows = rows.unionByName(gaps.select(F.col("gap").alias("size"), *none, "sequence_id"))
    order = [F.col("place").isNotNull(), F.col("size").desc(), F.col("place"), F.col("sequence_id")]
    if shards > 1:
        ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        rank = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + F.spark_partition_id()
        dealt = ranked.select((rank % shards).alias("shard"), "size", *names, "sequence_id").repartition(shards, "shard")
    else:
        dealt = rows.select(F.lit(0).cast("long").alias("shard"), "size", *names, "sequence_id").coalesce(1)
    return dealt.sortWithinPartitions("shard", *order).mapInArrow(_sweep(capacity, step, opens), SWEPT)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of (doc_id, text)."""
    pieces = stored(cut(docs, tokenizer_path, capacity, end_id), "pieces")
    return place(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def place(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pieces`` (PIECES), which are removed once read, with sequence_id and offset."""
    ends = [capacity]
    while ends[-1]:
        ends.append(ends[-1] // BAND)
    bands = list(zip(ends[1:], ends))
    # a number for each band
    sizes = pieces.agg(*[F.count(F.when((F.col("length") > low) & (F.col("length") <= high), 1)) for low, high in bands]).first()
    parts, gaps, n_gaps, step = [pieces.limit(0).select("*", *[F.lit(None).cast("long").alias(c) for c in ("sequence_id", "offset", "gap")])], None, 0, 0
    for (low, high), left in zip(bands, sizes):
        todo, again = pieces.where((F.col("length") > low) & (F.col("length") <= high)), False
        while left:
            shards = -(-(left + n_gaps) // shard)
            opens = again or shards == 1 or not n_gaps
            step += 1
            out = stored(swept(todo, gaps, shards, step, opens, capacity), "swept")
            found, left, n_gaps = out.agg(F.count("offset"), F.count(F.when(F.col("place").isNotNull() & F.col("offset").isNull(), 1)), F.count("gap")).first()
            if found:
                parts.append(out.where("offset is not null"))
            todo, again = out.where("place is not null and offset is null"), True
            gaps = out.where("gap is not null").select("sequence_id", "gap") if n_gaps else None
    out = parts[0] if len(parts) == 1 else parts[1]
    for more in parts[2:]:
        out = out.unionAll(more)
    if len(parts) > 1:
        forget(pieces)
    return out
