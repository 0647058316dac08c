"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words (see ``targets``). Among all document rates
``w`` that meet the targets, the one closest to 1 in relative entropy, at most ``most``,
tilts each document exponentially: ``w = min(most, exp(rate * size / mean size))``. The
one dual variable of each source is found by safeguarded Newton steps; a step is one
distributed aggregate over the counts of equal sizes in each source. All sums are of
whole numbers, so that reruns agree to the last bit.

Rates become copies: ``floor(w)`` and one more where a hash of the document lies below
the rest of ``w`` plus a shift. Shifts are chosen for each source and class of sizes,
from the largest sizes to the smallest, so that each class makes up for the words that
the classes before it took too many or too few; they come from counts in 1024 bins.

Built-in column functions only; no Python runs on the executors.

Defined cases: a null text has size 0, and documents of size 0 are taken with 0 words
and one copy; null sources are one source, the last; rows that repeat an id and text
share their hash and so their copies; ties do not arise, as shifts act on whole bins; an
empty table gives no rows; extra columns are kept by ``mix`` and never clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, free_name, let, sized_join, stored, words_of

WEIGHTS = (1, 2, 3)
#: Most copies of a document, and the most of its size that a source's target may be.
MOST = 3
BINS = 1024
#: Fixed-point units of a word in sums.
UNIT = 1 << 16
#: Newton steps at most, and the relative distance from a target that ends them; rounding makes up for the rest.
ROUNDS, CLOSE = 40, 1e-4


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and u (hash of id and text, 0 to 1) of every document."""
    size = F.size(words_of(F.col("text"))).cast("long")
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    return docs.select("doc_id", "source", size.alias("size"), u.alias("u"))


def ranked(by_source: DataFrame) -> DataFrame:
    """Adds nth, the place of the source in code-point order, null last: range-partitioned, numbered in partitions and shifted; one row for each partition meets in one task."""
    order = F.col("source").asc_nulls_last()
    runs = by_source.repartitionByRange(order).sortWithinPartitions(order)
    runs = stored(runs.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "sorted-sources")
    sizes = runs.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    return runs.join(starts, "part").withColumn("nth", F.col("before") + F.col("at")).drop("part", "at", "before")


def targets(by_source: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target to (source, source_size, n): all words shared by weight, at most ``most`` times the source's own, the excess reshared.

    Sources in code-point order, null last, weigh as ``weights`` repeating. Full sources
    are set aside and the rest is shared again until none is above; a round is one
    aggregate over the sources, of which the driver sees two whole numbers.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights)).cast("int") + 1)
    n = stored(ranked(by_source).select("source", "source_size", "n", w.cast("long").alias("w"), (most * F.col("source_size")).cast("long").alias("cap")), "weighted-sources")
    total, weight = n.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    level, full = total / weight if weight else 0.0, None
    while weight:
        above = F.col("w") * F.lit(level) >= F.col("cap")
        now = n.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0))).first()
        if now[0] == full or not now[2]:
            level = level if now[2] else float("inf")
            break
        full, level = now[0], (total - now[1]) / now[2]
    share = F.col("w") * F.lit(level) if level != float("inf") else F.col("cap").cast("double")
    return n.select("source", "source_size", "n", F.least(F.col("cap").cast("double"), share).alias("target"))


def rate(dual: Column, size: Column, mean: Column, most: int = MOST) -> Column:
    tilt = dual * size / mean
    return F.when(dual.isNull() | (tilt >= math.log(most)), F.lit(float(most))).otherwise(F.exp(tilt))


def newton_step(counts: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """One step for all sources of (s, target, mean, dual, low, high, off): one aggregate over the counts, which carries the state."""
    kept = ["s", "target", "mean", "dual", "low", "high"]
    met = counts.join(state.drop("off"), F.col("source").eqNullSafe(F.col("s")))
    x, w = F.col("size") / F.col("mean"), rate(F.col("dual"), F.col("size"), F.col("mean"), most)
    words = lambda v: F.sum(F.round(v * F.col("n") * UNIT).cast("decimal(38,0)")).cast("double") / UNIT
    sums = met.groupBy(*kept).agg(words(F.col("size") * w).alias("f"), words(F.when(F.col("dual") * x < math.log(most), F.col("size") * w * x).otherwise(0.0)).alias("g"))
    # in layers: each expression stands once in the plan
    out = sums.withColumn("by", F.log(F.greatest(F.col("f"), F.lit(1e-9)) / F.col("target"))).withColumn("off", F.abs("by"))
    out = out.withColumn("low", F.when(F.col("by") < 0, F.col("dual")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("by") > 0, F.col("dual")).otherwise(F.col("high")))
    out = out.withColumn("newton", F.col("dual") + F.greatest(F.least(-F.col("by") * F.col("f") / F.greatest(F.col("g"), F.lit(1e-300)), F.lit(8.0)), F.lit(-8.0)))
    newton, low, high = F.col("newton"), F.col("low"), F.col("high")
    inside = (newton > F.coalesce(low, F.lit(-1e300))) & (newton < F.coalesce(high, F.lit(1e300)))
    moved = F.when(F.col("off") <= CLOSE, F.col("dual")).when(inside, newton).otherwise((F.coalesce(low, newton) + F.coalesce(high, newton)) / 2)
    return out.select("s", "target", "mean", moved.alias("dual"), "low", "high", "off")


def duals(counts: DataFrame, goals: DataFrame, most: int = MOST, together: int = 3) -> DataFrame:
    """Adds dual (null: all documents ``most`` times) and mean to ``goals`` by Newton steps over (source, size, n)."""
    counts = counts.where("size > 0")
    guess = F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.greatest(F.col("source_size"), F.lit(1)))
    base = goals.select("source", "target", "source_size", (F.col("source_size") / F.greatest(F.col("n"), F.lit(1))).alias("mean"), guess.alias("guess"))
    # capped sources take every document ``most`` times and have no dual
    free = base.where((F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12)))
    none = F.lit(None).cast("double")
    state = stored(free.select(F.col("source").alias("s"), "target", "mean", F.col("guess").alias("dual"), none.alias("low"), none.alias("high"), F.lit(1.0).alias("off")), "duals")
    last = state
    for _ in range(ROUNDS // together):
        for _ in range(together):
            state = newton_step(counts, state, most)
        before, state = last, stored(state, "duals")
        last = state
        forget(before)
        if state.where(f"off > {CLOSE}").isEmpty():
            break
    return base.join(state.select("s", "dual"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "target", "source_size", "mean", "dual")


def size_class(size: Column) -> Column:
    """Quarters of powers of two: in small sources a class is a document or two, so that words are made up for finely."""
    return F.when(size > 0, F.floor(4 * F.log2(size.cast("double"))).cast("int")).otherwise(-1)


def shifts(slim: DataFrame, rates: DataFrame, most: int = MOST) -> DataFrame:
    """source and shifts (map of size class to the bin below which a document is taken once more)."""
    s = sized_join(slim.where("size > 0"), rates.select(F.col("source").alias("s"), "mean", "dual"), F.col("source").eqNullSafe(F.col("s")), "inner")
    w = rate(F.col("dual"), F.col("size"), F.col("mean"), most)
    base = F.floor(w)
    where = F.when(base >= most, F.lit(None)).otherwise(bin_of(w, F.col("u")))
    # map-side combined: a row for each source, class and bin at most
    binned = s.groupBy("source", size_class(F.col("size")).alias("class"), where.alias("bin")).agg(
        F.sum(F.col("size") * base).cast("long").alias("fixed"), F.sum("size").alias("words"), F.sum(F.round(F.col("size") * w * UNIT).cast("decimal(38,0)")).alias("want")
    )
    per_class = binned.groupBy("source", "class").agg(
        F.sum("fixed").alias("fixed"), (F.sum("want").cast("double") / UNIT).alias("want"),
        F.sort_array(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "words")))).alias("bins"),  # at most 2 * BINS
    )
    per_source = per_class.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "fixed", "want", "bins")), False).alias("classes"))  # a few dozen

    def step(acc: Column, c: Column) -> Column:
        need = acc["carry"] + c["want"] - c["fixed"]
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-BINS - 1).alias("bin"), F.abs(need).alias("off"), F.lit(0).cast("long").alias("got"))

        def more(a: Column, b: Column) -> Column:
            total = a["sum"] + b["words"]
            better = F.abs(need - total) < a["off"]
            return F.struct(total.alias("sum"), F.when(better, b["bin"]).otherwise(a["bin"]).alias("bin"), F.when(better, F.abs(need - total)).otherwise(a["off"]).alias("off"), F.when(better, total).otherwise(a["got"]).alias("got"))

        best = F.aggregate(c["bins"], start, more)
        return F.get(F.transform(F.array(best), lambda b: F.struct((need - b["got"]).alias("carry"), F.concat(acc["cuts"], F.array(F.struct(c["class"].alias("class"), b["bin"].alias("bin")))).alias("cuts"))), F.lit(0))

    none = F.array().cast("array<struct<class:int,bin:int>>")
    folded = F.aggregate("classes", F.struct(F.lit(0.0).alias("carry"), none.alias("cuts")), step, lambda a: a["cuts"])
    return per_source.select("source", F.map_from_entries(folded).alias("shifts"))


def bin_of(w: Column, u: Column) -> Column:
    """Bin of the shift from which on a document is taken once more, from -BINS to BINS."""
    return F.ceil((u - (w - F.floor(w))) * BINS).cast("int")


def plan(slim: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, mean, dual, shifts for every source of (source, size, u)."""
    counts = stored(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    by_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n"))
    goals = stored(targets(by_source, weights, most), "targets")
    rates = stored(duals(counts, goals, most), "rates")
    cuts = stored(shifts(slim, rates, most), "shifts")
    out = stored(rates.join(cuts.select(F.col("source").alias("s"), "shifts"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-plan")
    forget(counts, goals, rates, cuts)
    return out


def copies(size: Column, u: Column, p: Column, most: int = MOST) -> Column:
    """Copies of a document under the struct ``p`` of its source's plan."""
    w = rate(p["dual"], size, p["mean"], most)
    extra = (F.floor(w) < most) & (bin_of(w, u) <= F.coalesce(F.try_element_at(p["shifts"], size_class(size)), F.lit(-BINS - 1)))
    return F.when(size <= 0, 1).otherwise(F.floor(w) + extra.cast("int")).cast("int")


def with_copies(slim: DataFrame, by_source: DataFrame, name: str, most: int = MOST) -> DataFrame:
    p = free_name(slim, "plan")
    side = by_source.select(F.col("source").alias(f"{p}_s"), F.struct("source_size", "target", "mean", "dual", "shifts").alias(p))
    joined = sized_join(slim, side, F.col("source").eqNullSafe(F.col(f"{p}_s")))
    return joined.withColumn(name, F.struct(copies(F.col("size"), F.col("u"), F.col(p), most).alias("copies"), F.col(p)["source_size"].alias("source_size"), F.col(p)["target"].alias("target"))).drop(p, f"{p}_s")


def mix_report(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document."""
    slim = stored(sizes(docs), "doc-sizes")
    out = with_copies(slim, plan(slim, weights, most), "m", most)
    m = F.col("m")
    return out.select("doc_id", "source", "size", m["source_size"].cast("long").alias("source_size"), m["target"].alias("target"), m["copies"].alias("copies"), (m["copies"] * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    slim = stored(sizes(docs).drop("doc_id"), "doc-sizes")
    by_source = plan(slim, weights, most)
    forget(slim)
    p, n = free_name(docs, "plan"), free_name(docs, "copy")
    side = by_source.select(F.col("source").alias(f"{p}_s"), F.struct("mean", "dual", "shifts").alias(p))
    joined = sized_join(docs, side, F.col("source").eqNullSafe(F.col(f"{p}_s")))
    size, u = F.size(words_of(F.col("text"))).cast("long"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    # bound by let: the size, which splits the text, stands in many places of the expression
    facts = F.struct(size.alias("size"), u.alias("u"))
    some = joined.withColumn(n, let(facts, lambda x: F.array_repeat(F.lit(0), copies(x["size"], x["u"], F.col(p), most))))
    return some.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(n).alias(n)).drop(n)
