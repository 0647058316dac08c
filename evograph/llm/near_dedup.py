"""MinHash near-duplicate removal with sequential Bayesian verification.

1. Every text is reduced, where it lies, to its number of distinct word shingles,
   a 128-bit hash of the set, its MinHash signature and one key for each band of it.
   Texts with equal sets collapse to the smallest id (a map-side combined minimum).
2. In each bucket of two or more sets, the most central one (by the sizes of its
   buckets) is compared with the others: signatures batch by batch, dropping a pair
   as soon as the posterior probability of reaching the threshold falls under
   ``miss``. Only signatures travel to this test; the texts of its survivors alone are
   fetched, and their pairs verified on full shingle sets.
3. Where a bucket's other members still lie in several components, the members
   outside its largest component are compared, in blocks, with all the others, so
   that no link between different components goes unseen: signatures first, then the
   texts of those that have a survivor. The members of large buckets meet by their
   rarest shingles instead (prefix filter) where that leaves fewer pairs; no pair that
   reaches the threshold is lost by it. No block returns all pairs.
4. Components by repeated contraction of the links to the smallest label.

A hot bucket or hub is dealt over many units (salts, blocks); a unit holds a bounded
block and streams the other side. Bands miss a pair of similarity 0.8 with
probability (1 - 0.8**rows)**bands; nothing is cut from a bucket, whatever its size.

Defined cases: null and empty texts have no shingles and no links; a null id has a
null component and is kept; rows that repeat an id are one document (each row counts
its own shingles); ties go to the smallest id; empty tables give no rows; texts of
any length are used whole; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, forget, sized_join, stored
from .thin import thin_join

BANDS, ROWS = 32, 5
#: Hashes that are compared between two looks at the posterior.
STEP = 32
#: Posterior probability of a similarity at the threshold under which a pair is dropped.
MISS = 1e-6
#: Words whose hash a worker keeps.
CACHE_WORDS = 150_000
#: Documents and shingles that one unit holds while the others stream by.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 400_000
#: Rows that stream by a unit's block, and members of a hub's star that one unit compares.
STREAM, STAR = 512, 512
#: Slots in which shingles are counted, for the order of their rarity.
SLOTS = 1 << 20

_M = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a permutation whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(33))) * _M[0]
    x = (x ^ (x >> np.uint64(33))) * _M[1]
    return x ^ (x >> np.uint64(33))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


@cache
def _constants(bands: int, rows: int) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20_011)
    odd = lambda n, kind: rng.integers(0, np.iinfo(kind).max, n, kind) | kind(1)
    k = bands * rows
    return odd(k, np.uint32)[:, None], rng.integers(0, 1 << 32, k, np.uint32)[:, None], odd(k, np.uint64), odd(bands, np.uint64)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; of the whole sequence when there are fewer words."""
    words = text.lower().split()  # of bytes: A-Z only, and white space as in the contract
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """MinHash values of a set of hashes that isn't empty."""
    a, b, *_ = _constants(bands, rows)
    x, out = (s >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(x), 2048):
        part = (x[None, i : i + 2048] * a + b).min(axis=1)
        out = part if out is None else np.minimum(out, part)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    _, _, m, start = _constants(bands, rows)
    return mix((mix(sig.astype(np.uint64) * m).reshape(bands, rows)).sum(axis=1, dtype=np.uint64) + start)


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]


def digests(docs: DataFrame, n: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (hash of the set), keys (one for each band) and sig (16 bits of each hash); the last two null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())]
        for batch in few_rows(batches):
            size, a, b, keys, sigs = [], [], [], [], []
            for text in _texts(batch, 1):
                s = shingles(text, n)
                size.append(len(s))
                m = mix(s)
                a.append(m.sum(dtype=np.uint64).view(np.int64))
                b.append(np.bitwise_xor.reduce(m * _M[1]).view(np.int64) if len(s) else 0)
                sig = signature(s, bands, rows) if len(s) else None
                keys.append(None if sig is None else band_keys(sig, bands, rows).view(np.int64))
                sigs.append(None if sig is None else sig.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, (_, k) in zip((size, a, b, keys, sigs), kinds[1:])]], [k for k, _ in kinds])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, sig binary")


@cache
def fewest_matches(threshold: float, hashes: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(hashes seen, fewest matches): with fewer, Pr(similarity >= threshold) under a uniform prior is below ``miss``."""
    out = []
    for n in [*range(STEP, hashes, STEP), hashes]:
        tail, m = 0.0, -1  # the posterior is Beta(m + 1, n - m + 1), and its tail Pr(Binomial(n + 1, threshold) <= m)
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, looks: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices into both blocks of signatures of the pairs that pass every look, and their matches."""
    done, (n, least) = 0, looks[0]
    found = [(np.full(len(right), i), np.arange(len(right)), (right[:, :n] == left[i, :n]).sum(axis=1)) for i in range(len(left))]
    i, j, m = (np.concatenate(x) for x in zip(*((a[k], b[k], c[k]) for a, b, c in found for k in [c >= least])))
    for done, (n, least) in zip([x for x, _ in looks], looks[1:]):
        m = m + (left[i, done:n] == right[j, done:n]).sum(axis=1)
        keep = m >= least
        i, j, m = i[keep], j[keep], m[keep]
    return i, j, m


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets (sorted, distinct)."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


ROLE = "unit_a long, unit_b long, held boolean, label long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple], list[tuple]]]:
    """(unit, held rows, other rows), 512 at most together, of rows sorted by unit with held ones first; a row is (id, label, sig, n_shingles, ...)."""
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        at, end = 0, len(cols[0])
        while at < end:
            key, stop = (cols[0][at], cols[1][at]), at
            while stop < end and (cols[0][stop], cols[1][stop]) == key and stop - at < 512:
                stop += 1
            rows = list(zip(*(c[at:stop] for c in cols[3:])))
            flags = cols[2][at:stop]
            yield key, [r for r, h in zip(rows, flags) if h], [r for r, h in zip(rows, flags) if not h]
            at = stop


def _signatures(rows: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(len(rows), -1)


def _able(first: list[tuple], second: list[tuple], looks: tuple[tuple[int, int], ...], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs that pass every look, and whose sizes alone do not rule them out."""
    i, j, m = survivors(_signatures(first), _signatures(second), looks)
    a, b = (np.array([r[3] for r in rows], np.int64) for rows in (first, second))
    able = 100 * np.minimum(a[i], b[j]) >= percent * np.maximum(a[i], b[j])
    return i[able], j[able], m[able]


def _sift(looks: tuple[tuple[int, int], ...], percent: int):
    """The rows of units that have a pair of another label which may be similar."""

    def apart(first: list[tuple], second: list[tuple]) -> tuple[set[int], set[int]]:
        """Ids on either side that are in such a pair."""
        if not first or not second:
            return set(), set()
        i, j, _ = _able(first, second, looks, percent)
        la, lb = (np.array([r[1] for r in rows], np.int64) for rows in (first, second))
        differ = la[i] != lb[j]
        return {first[k][0] for k in np.unique(i[differ])}, {second[k][0] for k in np.unique(j[differ])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, kept, out = None, [], set(), []
        for unit_now, new, rest in _runs(batches):
            if unit_now != unit:
                out.extend((*unit, True, r[1], r[0]) for r in held if r[0] in kept)
                unit, held, kept = unit_now, [], set()
            if new:
                kept.update(*apart(held, new), *apart(new, new))
                held = held + new
            met, passed = apart(held, rest)
            kept |= met
            out.extend((*unit, False, r[1], r[0]) for r in rest if r[0] in passed)
            if len(out) > 10_000:
                yield _columns(out, ROLE + ", id long")
                out = []
        out.extend((*unit, True, r[1], r[0]) for r in held if r[0] in kept)
        yield _columns(out, ROLE + ", id long")

    return run


_ARROW = {"long": pa.int64(), "boolean": pa.bool_()}


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], list(names))


def _link(n: int, percent: int, looks: tuple[tuple[int, int], ...]):
    """Links that join components within each unit, verified on full sets: its held rows against all that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, up = None, [], {}
        sets: dict[int, np.ndarray] = {}  # of held rows, whose number is bounded, by place in memory

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        def whole(row: tuple, of: dict[int, np.ndarray]) -> np.ndarray:
            """The set of a row, made where a pair first asks for it."""
            if id(row) not in of:
                of[id(row)] = shingles(row[4] or b"", n)
            return of[id(row)]

        def linked(first: list[tuple], second: list[tuple], of: dict[int, np.ndarray]) -> Iterator[tuple[int, int]]:
            i, j, m = _able(first, second, looks, percent)
            for k in np.lexsort((j, -m)):
                x, y = first[i[k]], second[j[k]]
                if x[0] != y[0] and (ra := root(x[1])) != (rb := root(y[1])) and similar(whole(x, sets), whole(y, of), percent):
                    up[max(ra, rb)] = min(ra, rb)
                    yield min(x[0], y[0]), max(x[0], y[0])

        for unit_now, new, rest in _runs(_as_bytes(batches)):
            if unit_now != unit:
                unit, held, up, sets = unit_now, [], {}, {}
            out = []
            if new:
                if held:
                    out += linked(held, new, sets)
                out += linked(new, new, sets)
                held = held + new
            if rest and held:
                out += linked(held, rest, {})
            yield _columns(out, "a long, b long")

    return run


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as bytes; a few rows at a time."""
    for part in few_rows(batches, 512):
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], part.columns[-1].cast(pa.binary())], part.schema.names)


def _dealt(roles: DataFrame) -> DataFrame:
    """id and its roles in arrays of a bounded length, so that what joins by id travels once for many of them."""
    fields = [x.split()[0] for x in ROLE.split(", ")]
    part = F.pmod(F.xxhash64("unit_a", "unit_b"), F.lit(64))
    return roles.groupBy("id", part.alias("part")).agg(F.collect_list(F.struct(*fields)).alias("roles")).select("id", "roles")


def _met(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (id, roles, sig, more) as sorted units of one row for each role."""
    spread = rows.select("id", "sig", "n_shingles", *more, F.explode("roles").alias("r")).select("r.unit_a", "r.unit_b", "r.held", "id", "r.label", "sig", "n_shingles", *more)
    return spread.repartition("unit_a", "unit_b").sortWithinPartitions("unit_a", "unit_b", F.col("held").desc(), "id")


def verified(docs: DataFrame, sigs: DataFrame, roles: DataFrame, n: int, percent: int, miss: float, name: str) -> DataFrame:
    """Links (a, b) among the rows that meet in units; ``roles``: id and the fields of ROLE, ``sigs``: id, sig and n_shingles."""
    looks = fewest_matches(percent / 100, BANDS * ROWS, miss)
    dealt = stored(_dealt(roles), f"{name}-roles")
    passed = stored(_met(thin_join(sigs, dealt, "id", "id")).mapInArrow(_sift(looks, percent), ROLE + ", id long"), f"{name}-passed")
    again = stored(_dealt(passed), f"{name}-passed-roles")
    asked = stored(thin_join(sigs, again, "id", "id"), f"{name}-asked")
    texts = thin_join(docs.select("doc_id", "text"), asked, "doc_id", "id").drop("doc_id")
    out = stored(_met(texts, "text").mapInArrow(_link(n, percent, looks), "a long, b long").distinct(), f"{name}-links")
    forget(dealt, passed, again, asked)
    return out


def components(links: DataFrame, name: str) -> DataFrame:
    """(id, label) for every id of ``links`` (a, b): the smallest id that it reaches."""
    edges, labels, old = links.where("a <> b"), None, []
    while True:
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
        first = stored(both.groupBy("id").agg(F.least(F.min("other"), F.min("id")).alias("p")), f"{name}-up")
        over = first.select(F.col("id").alias("p"), F.col("p").alias("q"))
        up = stored(first.join(over, "p", "left").select("id", F.coalesce("q", "p").alias("label")), f"{name}-jump")
        old += [first, labels]
        if labels is None:
            labels = up
        else:
            by = up.select(F.col("id").alias("label"), F.col("label").alias("next"))
            labels = stored(sized_join(labels, by, "label").select("id", F.coalesce("next", "label").alias("label")), f"{name}-labels")
            old.append(up)
        a, b = (up.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        before, edges = edges, sized_join(sized_join(edges, a, "a"), b, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).where("a <> b").distinct()
        edges = stored(edges, f"{name}-edges")
        forget(*old, before)
        old = [edges]
        if edges.isEmpty():
            forget(*old)
            return labels


def _rarity(texts: DataFrame, n: int) -> np.ndarray:
    """Times that shingles fall in each of SLOTS slots of their hashes; bounded, whatever the number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(SLOTS, np.int64)
        for batch in few_rows(batches):
            for text in _texts(batch, 0):
                np.add.at(found, shingles(text, n) % np.uint64(SLOTS), 1)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["slot", "n"])

    table = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out


def rarest(s: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the order of ``rarity``, then hash: sets that reach the threshold have one of these in common."""
    most = len(s) + percent * len(s) // -100 + 1  # at least percent of either set is in both: the first of those is here
    return s[np.lexsort((s, rarity[(s % np.uint64(len(rarity))).astype(np.int64)]))[:most]]


def prefixes(texts: DataFrame, n: int, percent: int, rarity: np.ndarray) -> DataFrame:
    """key, id, n_shingles, label: a row for each of the ``rarest`` shingles of ``texts`` (id, n_shingles, label, text)."""
    sent = texts.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            keys = [rarest(shingles(text, n), sent.value, percent) for text in _texts(batch, 3)]
            rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), *[batch.column(c).take(pa.array(rows)) for c in range(3)]], ["key", "id", "n_shingles", "label"])

    return texts.select("id", "n_shingles", "label", "text").mapInArrow(run, "key long, id long, n_shingles long, label long")


def _work(rows: DataFrame) -> DataFrame:
    """key, pairs: what the blocks compare in a bucket, its members outside its largest component with all."""
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("all"), F.max("c").alias("main"))
    return sizes.select("key", ((F.col("all") - F.col("main")).cast("double") * F.col("all")).alias("pairs"))


def divided(docs: DataFrame, left: DataFrame, n: int, percent: int) -> DataFrame:
    """Open buckets (key, id, n_shingles, label); the members of large ones meet by their rarest shingles instead, where that leaves fewer pairs.

    No pair that reaches the threshold is lost, as it has one of these shingles in common:
    what is cut holds no link. Parts that lie in one component are left out, and of parts
    with the same members all but one.
    """
    large = stored(_work(left).where(F.col("pairs") > (16 * BLOCK_DOCS) ** 2), "large-buckets")
    if large.isEmpty():
        return left
    keys = large.select("key")
    ids = stored(sized_join(left, keys, "key", "left_semi").select("id", "n_shingles", "label").distinct(), "large-members")
    texts = stored(thin_join(docs.select("doc_id", "text"), ids, "doc_id", "id").select("id", "n_shingles", "label", "text"), "large-texts")
    found = stored(prefixes(texts, n, percent, _rarity(texts, n)).distinct(), "prefixes")
    forget(texts, ids)
    # an id may have rows of several sizes: hashed with the size, no two rows of a part cancel each other
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "id", "n_shingles")).alias(f"same_{seed}") for seed in (1, 2)]
    parts = found.groupBy("key").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high"), *same).where("low <> high")
    parts = stored(parts.groupBy("c", "same_1", "same_2").agg(F.min("key").alias("key")).select("key"), "parts")
    cut = stored(sized_join(found, parts, "key", "left_semi"), "cut-members")
    forget(found, parts)
    before, after = (df.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0] for df in (large, _work(cut)))
    if after >= before:
        forget(cut)
        return left
    return stored(sized_join(left, keys, "key", "left_anti").unionByName(cut), "divided")


def label(docs: DataFrame, n: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = stored(digests(docs, n), "digests")
    real = found.where("doc_id is not null and n_shingles > 0")
    same = real.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    same = stored(same.where("rep <> last").drop("last"), "equal-sets")
    # the representative of each set stands for its copies from here on
    with_rep = sized_join(found, same, ["set_a", "set_b", "n_shingles"])
    again = stored(real.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not again.isEmpty():  # equal rows meet once
        repeats = sized_join(found, again, "doc_id", "left_semi").dropDuplicates(["doc_id", "set_a", "set_b", "n_shingles"])
        found_once = sized_join(found, again, "doc_id", "left_anti").unionByName(repeats)
    else:
        found_once = found
    once = sized_join(found_once, same, ["set_a", "set_b", "n_shingles"]).where("doc_id is not null and n_shingles > 0 and (rep is null or rep = doc_id)")
    reps = once.select(F.col("doc_id").alias("id"), "n_shingles", "keys", "sig")
    sigs = reps.select("id", "sig", "n_shingles")
    in_band = reps.select(F.explode("keys").alias("key"), "id", "n_shingles")
    several = stored(in_band.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("m")).where("low <> high").select("key", "m"), "buckets")
    members = stored(sized_join(in_band, several, "key", "inner"), "members")
    central = stored(members.groupBy("id").agg(F.sum("m").alias("centrality")), "central")
    hubs = sized_join(members.select("key", "id"), central, "id", "inner").groupBy("key").agg(F.max(F.struct("centrality", (-F.col("id")).alias("low"))).alias("top"))
    hubs = stored(hubs.select("key", (-F.col("top.low")).alias("hub")), "hubs")
    pairs = stored(sized_join(members.select("key", "id"), hubs, "key", "inner").where("id <> hub").select("hub", "id").distinct(), "pairs")
    salts = stored(pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).alias("salts")), "salts")
    spread = sized_join(pairs, salts, "hub", "inner").select("id", F.col("hub").alias("unit_a"), F.pmod(F.xxhash64("id"), F.col("salts")).alias("unit_b"))
    stars = spread.select("id", "unit_a", "unit_b", F.lit(False).alias("held"), F.col("id").alias("label")).unionAll(
        spread.select("unit_a", "unit_b").distinct().select(F.col("unit_a").alias("id"), "unit_a", "unit_b", F.lit(True).alias("held"), F.col("unit_a").alias("label"))
    )
    links = verified(docs, sigs, stars, n, percent, miss, "stars")
    labels = components(links, "stars")

    # buckets whose members, without the hub (it has met all), lie in several components
    left = sized_join(members, hubs, "key", "inner").where("m > 2 and id <> hub").select("key", "id", "n_shingles")
    left = stored(sized_join(left, labels, "id").select("key", "id", "n_shingles", F.coalesce("label", "id").alias("label")), "left")
    open_ = stored(left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "open")
    if not open_.isEmpty():
        left = divided(docs, stored(sized_join(left, open_, "key", "inner"), "open-members"), n, percent)
        sizes = left.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("w"))
        sizes = stored(sizes, "open-sizes")
        per_key = sizes.groupBy("key").agg(F.max(F.struct("c", (-F.col("label")).alias("low"))).alias("top"), F.sum("c").alias("all_docs"), F.sum("w").alias("all_w"))
        per_key = sized_join(per_key.select("key", (-F.col("top.low")).alias("main"), F.col("top.c").alias("main_docs"), "all_docs", "all_w"), sizes.select("key", F.col("label").alias("main"), "w"), ["key", "main"], "inner")
        minor = F.col("all_docs") - F.col("main_docs")
        per_key = stored(per_key.select("key", "main", F.greatest(F.ceil(minor / BLOCK_DOCS), F.ceil((F.col("all_w") - F.col("w")) / BLOCK_SHINGLES)).cast("long").alias("rows"), F.ceil(F.col("all_docs") / STREAM).cast("long").alias("columns")), "blocks")
        placed = sized_join(left, per_key, "key", "inner")
        i = F.pmod(F.xxhash64("id", F.lit(1)), F.col("rows"))
        j = F.pmod(F.xxhash64("id", F.lit(2)), F.col("columns"))
        held = placed.where("label <> main").select("id", "key", i.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("j"), "columns", F.lit(True).alias("held"), "label")
        met = placed.select("id", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i"), j.alias("j"), "columns", F.lit(False).alias("held"), "label")
        roles = held.unionAll(met).select("id", F.col("key").alias("unit_a"), (F.col("i") * F.col("columns") + F.col("j")).alias("unit_b"), "held", "label")
        more = verified(docs, sigs, roles, n, percent, miss, "rest")
        if not more.isEmpty():
            labels = components(links.unionAll(more), "all")

    forget(again, several, members, central, hubs, pairs, salts, links)
    rep = F.coalesce("rep", "doc_id")
    out = sized_join(with_rep.select("doc_id", "n_shingles", rep.alias("rep")), labels.select(F.col("id").alias("rep"), "label"), "rep")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, n: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One document of each group, with the columns of ``docs``; of rows that repeat a kept id with the same text, one."""
    dropped = label(docs, n, percent, miss).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    out = sized_join(docs, stored(dropped, "dropped"), F.col("doc_id") == F.col("gone"), "left_anti")
    again = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("gone")), "repeated")
    if again.isEmpty():
        return out.select(*[F.col(f"`{c}`") for c in docs.columns])
    once = sized_join(out, again, F.col("doc_id") == F.col("gone"), "left_anti")
    rest = sized_join(out, again, F.col("doc_id") == F.col("gone"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionAll(rest).select(*[F.col(f"`{c}`") for c in docs.columns])
