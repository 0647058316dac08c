"""URL filter by the ratio of two character language models.

Domain and path rules judge what they fit. All other urls are judged by two smoothed
variable-order Markov models over bytes, one of the urls that rules allow and one of
those that they block: contexts of up to ORDER bytes, interpolated with the next shorter
one by Witten-Bell weights; long contexts are kept where the corpus shows them often
enough, so that the model grows with it. Counts, probabilities and the table that urls
are scored with are distributed tables.

The log ratio of a url is a sum of one weight for each gram in it: what a gram adds to
the ratio of its suffix, and what the gram adds, as a context, to bytes that were not
seen behind it. Such a table may be cut anywhere, so it goes to the executors in parts
of bounded size, each of which adds its share to the sums. A url's score is its ratio for
each byte; the threshold is the middle of those with the best balanced accuracy on a
fifth of the ruled urls that trained neither model.

Defined cases: a null url or one without ``://`` has an empty host and path and fits no
rule; null and empty urls score 0; without allowed or without blocked urls every score
is 0 and the verdict is allow; repeated urls count each; ties at the threshold are
allowed; urls of any length are read whole; empty tables give no rows; extra columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, sized_join, stored

#: Fixed values: (verdict, host, path) of the production rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Bytes of the longest contexts, and how often a gram longer than SHORT must be seen.
ORDER, SHORT, OFTEN = 6, 3, 2
#: Entries of the model that are sent to the executors at once (64 MB).
PART = 4_000_000
#: Bins of scores for the threshold, from -LIMIT to LIMIT.
BINS, LIMIT = 400, 4.0
#: Symbols before a url and behind it; the bytes 0 and 1 are read as 2.
START, END = 0, 1


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty without ``://``."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(whole, pattern, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(whole, pattern, 2)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, (v, h, p) in reversed(list(zip(fits, ordered))):
        text, verdict = F.when(fit, h + p).otherwise(text), F.when(fit, v).otherwise(verdict)
    return text, verdict


def grams(urls: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length from 1 to ORDER + 1, the grams that end at each byte, before the first and behind the last; and the place where each url begins.

    A gram is a number: its length in the eighth byte, below it its symbols, the latest last.
    """
    data = [(u or "").encode() for u in urls]
    sizes = np.array([len(d) + 2 for d in data], np.int64)
    pad = b"\0" * ORDER
    raw = np.frombuffer(b"".join(pad + b"\2" + d + b"\2" for d in data), np.uint8)
    symbols = np.maximum(raw, 2).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    first = begins + ORDER * np.arange(1, len(data) + 1)  # of each url's start symbol
    for k in range(ORDER + 1):
        symbols[first - k] = START
    symbols[first + sizes - 1] = END
    own = np.repeat(first - begins, sizes) + np.arange(sizes.sum())
    out, packed = [], np.zeros(len(own), np.int64)
    for k in range(ORDER + 1):
        packed = packed | (symbols[own - k] << (8 * k))
        out.append(packed | ((k + 1) << 56))
    return out, begins


def counts(urls: DataFrame) -> DataFrame:
    """code, n0 and n1 (uses among allowed and blocked urls) of the grams of (url, blocked) that are seen often enough; combined in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocked = batch.column(1).to_numpy(zero_copy_only=False)
            text = np.array(batch.column(0).to_pylist(), object)
            for kind in (0, 1):
                of = text[blocked == kind].tolist()
                if of:
                    codes, begins = grams(of)
                    predicted = np.ones(len(codes[0]), bool)
                    predicted[begins] = False  # the start symbol is no prediction
                    for c in codes:
                        code, n = np.unique(c[predicted], return_counts=True)
                        none = np.zeros(len(n), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code, none if kind else n, n if kind else none)], ["code", "n0", "n1"])

    seen = urls.select("url", "blocked").mapInArrow(run, "code long, n0 long, n1 long").groupBy("code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return seen.where((_length(F.col("code")) <= SHORT) | (F.col("n0") + F.col("n1") >= OFTEN))


def _length(code: Column) -> Column:
    return F.shiftright(code, 56)


def _coded(length: Column, symbols: Column) -> Column:
    return F.call_function("shiftleft", length.cast("long"), F.lit(56)).bitwiseOR(symbols)


def context(code: Column) -> Column:
    """The gram without its last symbol."""
    return _coded(_length(code) - 1, F.shiftright(code.bitwiseAND((1 << 56) - 1), 8))


def suffix(code: Column) -> Column:
    """The gram without its first symbol."""
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), (8 * (_length(code) - 1)).cast("int")) - 1
    return _coded(_length(code) - 1, code.bitwiseAND(whole))


def weights(found: DataFrame) -> DataFrame:
    """code and weight of every gram and context of (code, n0, n1): see the module's text. The empty context has code 0."""
    kinds = lambda c: F.count(F.when(F.col(c) > 0, 1))
    contexts = found.groupBy(context(F.col("code")).alias("context")).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), kinds("n0").alias("k0"), kinds("n1").alias("k1"))
    rest = lambda k: F.when(F.col(f"t{k}") > 0, F.col(f"k{k}") / (F.col(f"t{k}") + F.col(f"k{k}"))).otherwise(1.0)
    contexts = stored(contexts.select("*", rest(0).alias("r0"), rest(1).alias("r1"), (F.log(rest(0)) - F.log(rest(1))).alias("back")), "contexts")
    met = sized_join(found.withColumn("context", context(F.col("code"))), contexts, "context", "inner")
    own = lambda k: F.when(F.col(f"t{k}") > 0, F.col(f"n{k}") / (F.col(f"t{k}") + F.col(f"k{k}"))).otherwise(0.0)
    parts = stored(met.select("code", suffix(F.col("code")).alias("suffix"), own(0).alias("o0"), own(1).alias("o1"), "r0", "r1", "back"), "grams")
    levels, shorter = [], None
    for n in range(1, ORDER + 2):
        level = parts.where(_length(F.col("code")) == n)
        if shorter is None:
            level = level.select("*", F.lit(1 / 256).alias("s0"), F.lit(1 / 256).alias("s1"))
        else:
            below = shorter.select(F.col("code").alias("suffix"), F.col("p0").alias("s0"), F.col("p1").alias("s1"))
            level = sized_join(level, below, "suffix", "inner")
        p = [F.col(f"o{k}") + F.col(f"r{k}") * F.col(f"s{k}") for k in (0, 1)]
        adds = F.log(p[0]) - F.log(p[1]) - F.log("s0") + F.log("s1") - F.col("back")
        shorter = stored(level.select("code", p[0].alias("p0"), p[1].alias("p1"), adds.alias("weight")), "probabilities")
        levels.append(shorter)
    all_ = contexts.select(F.col("context").alias("code"), F.col("back").alias("weight"))
    for level in levels:
        all_ = all_.unionAll(level.select("code", "weight"))
    out = stored(all_.groupBy("code").agg(F.sum("weight").alias("weight")), "url-model")
    forget(contexts, parts, *levels)
    return out


@dataclass
class Model:
    """Weights by gram, a stored table (null: no model), the number of its parts, and the threshold."""

    weights: DataFrame | None = None
    parts: int = 1
    threshold: float = 0.0

    def scored(self, urls: DataFrame, name: str = "score") -> DataFrame:
        """``urls`` with ``name``: log-likelihood ratio, allowed to blocked, for each byte of the column url; 0 for urls without any."""
        total = f"{name}_sum"
        size = F.octet_length(F.coalesce("url", F.lit("")))
        if self.weights is None:
            return urls.withColumn(name, F.lit(0.0))
        out = urls.withColumn(total, F.lit(0.0))
        for k in range(self.parts):
            part = self.weights.where(F.pmod(F.xxhash64("code"), F.lit(self.parts)) == k).toArrow()  # about PART rows
            code, weight = (part.column(c).to_numpy() for c in (0, 1))
            order = np.argsort(code)
            sent = urls.sparkSession.sparkContext.broadcast((code[order], weight[order]))
            before = out
            out = out.mapInArrow(_adder(sent, out.columns.index("url"), out.columns.index(total)), out.schema)
            if self.parts > 1:  # one part at a time in the workers' memory
                out = stored(out, "url-sums")
                forget(before)
        return out.withColumn(name, F.when(size > 0, F.col(total) / (size + 1)).otherwise(0.0)).drop(total)


def _adder(sent, url_at: int, total_at: int):
    """Adds the weights of the grams of the urls to the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, weight = sent.value
        empty = float(weight[0]) if len(codes) and codes[0] == 0 else 0.0
        for batch in batches:
            urls = batch.column(url_at).to_pylist()
            sums = np.zeros(len(urls))
            if urls and len(codes):
                found, begins = grams(urls)
                per = np.zeros(len(found[0]))
                for n, c in enumerate(found, 1):
                    low, high = np.searchsorted(codes, (n << 56, (n + 1) << 56))
                    if low < high:
                        at = np.minimum(np.searchsorted(codes[low:high], c), high - low - 1) + low
                        per += np.where(codes[at] == c, weight[at], 0.0)
                sums = np.add.reduceat(per, begins) + empty * (np.diff(np.append(begins, len(per))) - 1)
            columns = list(batch.columns)
            columns[total_at] = pa.array(columns[total_at].to_numpy(zero_copy_only=False) + sums)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def learn(pages: DataFrame, rules=RULES) -> Model:
    """Model from the urls of ``pages`` (page_id, url) that the rules judge."""
    host, path = parts(F.col("url"))
    known = pages.select("url", (ruled(host, path, rules)[1] == "block").cast("int").alias("blocked"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("aside")).where("blocked is not null")
    found = stored(counts(known.where("not aside")), "url-grams")
    both = found.agg(F.coalesce(F.max("n0"), F.lit(0)), F.coalesce(F.max("n1"), F.lit(0)), F.count("*")).first()
    if not both[0] or not both[1]:
        return Model()
    model = Model(weights(found))
    forget(found)
    model.parts = -(-model.weights.count() // PART)
    held = np.zeros((2, BINS))
    at = F.least(F.greatest(F.floor((F.col("score") + LIMIT) / (2 * LIMIT) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    for r in model.scored(known.where("aside").select("url", "blocked")).groupBy("blocked", at.alias("bin")).count().collect():
        held[r["blocked"], r["bin"]] = r["count"]
    if held.sum(axis=1).all():
        share = held / held.sum(axis=1, keepdims=True)
        right = np.concatenate([[0], np.cumsum(share[1])]) + 1 - np.concatenate([[0], np.cumsum(share[0])])
        best = np.flatnonzero(right >= right.max() - 1e-12)
        model.threshold = float(best[len(best) // 2] / BINS * 2 * LIMIT - LIMIT)
    return model


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, score, verdict for every row of (page_id, url)."""
    scored = model.scored(pages.select("page_id", "url"))
    host, path = parts(F.col("url"))
    rule, verdict = ruled(host, path, rules)
    out = scored.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), "score", verdict.alias("ruled"))
    return out.select("page_id", "host", "path", "rule", "score", F.coalesce("ruled", F.when(F.col("score") >= model.threshold, "allow").otherwise("block")).alias("verdict"))
