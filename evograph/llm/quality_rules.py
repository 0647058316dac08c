"""Quality rules: a learned, ordered decision list of threshold conjunctions.

Features are built-in column expressions. A bounded sample of labelled rows is
reduced, in Spark, to counts by binned features and label; sequential covering
grows and prunes conjunctions on those counts; the rules come out as one ordered
conditional expression. No Python runs on the executors.

Defined cases: a null text has no words, so its row fails the base rule; empty
texts likewise; an empty table gives no rows; with no labels, or labels of one
class, no rule is learned and the base rule alone decides; repeated labels count
each time; ties between literals go to the first feature and lowest threshold.
Extra columns of the input are kept and never clash with work columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, let, stored, words_of

WINDOW = 8
#: Labelled rows that are looked at at most, by hash of the id.
SAMPLE_ROWS = 20_000
SYMBOLS = "[#*$%&|<>]"
#: Features that rules may test, all computed from the text.
FEATURES = ("symbol_rate", "repeat_rate", "dup_line_rate", "mean_length", "upper_rate", "shout_rate", "distinct_rate", "size")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that stand in a ``window``-word window found twice or more, first included (windows compared by 64-bit hash)."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        def marked(s: Column) -> Column:
            return F.sort_array(F.transform(F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))), lambda e: e["i"]))

        at = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked)
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= window, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def with_stats(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the struct column ``name`` of the base statistics of the text.

    Words and lines are bound by ``let``: a filter on the statistics is pushed below
    projections, where a column used inside a lambda would be computed for each element.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    long = lambda c: c.cast("long")

    def stats(words: Column, lines: Column) -> Column:
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.char_length(F.array_join(words, ""))).alias("word_chars"),
            long(F.regexp_count(whole, F.lit(SYMBOLS))).alias("n_symbols"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            long(F.size(lines)).alias("n_lines"),
            repeat_words(words).alias("n_repeat_words"),
            long(F.size(F.array_distinct(words))).alias("n_distinct"),
            long(F.regexp_count(whole, F.lit("\\p{Lu}"))).alias("n_upper"),
            long(F.regexp_count(whole, F.lit("[!?]"))).alias("n_shout"),
        )

    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return df.withColumn(name, let(words_of(F.col(text)), lambda w: let(lines, lambda ls: stats(w, ls))))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """Name to double column; empty texts give zeros."""
    per = lambda a, b: (s[a] / F.greatest(s[b], F.lit(1))).cast("double")
    return {
        "symbol_rate": per("n_symbols", "n_words"), "repeat_rate": per("n_repeat_words", "n_words"), "dup_line_rate": per("n_dup_lines", "n_lines"),
        "mean_length": per("word_chars", "n_words"), "upper_rate": per("n_upper", "word_chars"), "shout_rate": per("n_shout", "n_words"),
        "distinct_rate": per("n_distinct", "n_words"), "size": s["n_words"].cast("double"),
    }


@dataclass(frozen=True)
class Literal:
    """``feature >= cut`` where ``above``, else ``feature < cut``."""

    feature: str
    above: bool
    cut: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= self.cut if self.above else of[self.feature] < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first whose literals all hold rejects."""

    rules: list[list[Literal]] = field(default_factory=list)

    def fired(self, of: dict[str, Column]) -> Column:
        """Number of the first rule that holds, from 1; 0 where none does."""
        out = None
        for n, rule in enumerate(self.rules, 1):
            test = rule[0].column(of)
            for x in rule[1:]:
                test = test & x.column(of)
            out = F.when(test, n) if out is None else out.when(test, n)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules)


def labelled_counts(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[dict[str, list[float]], np.ndarray, np.ndarray]:
    """Cuts by feature; the binned features, and by row: fold, label, count."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").alias("bad"))
    # a row for each id and label, however often it is given
    known = known.groupBy("doc_id", (1 - F.col("bad")).alias("bad")).agg(F.count("*").alias("times"))
    total = known.count()
    if total > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    # about sample_rows rows of an id and a flag: bounded, so it may be sent to every executor
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    of = with_stats(rows, "text", "s")
    feats = features(F.col("s"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0

    kept = stored(of.select(fold.alias("fold"), "bad", "times", base_failed(F.col("s")).alias("failed"), *[feats[f].alias(f) for f in FEATURES]), "rules-sample")
    sample = kept.where("not failed")  # the others are decided already
    points = [i / 40 for i in range(41)]
    by_class = sample.groupBy("bad").agg(*[F.percentile_approx(f, points, 10_000).alias(f) for f in FEATURES]).collect()
    if len(by_class) < 2:
        return {}, np.zeros((0, len(FEATURES)), int), np.zeros((0, 3), int)
    cuts = {}
    for f in FEATURES:
        at = sorted({v for r in by_class for v in r[f]})
        cuts[f] = sorted({(a + b) / 2 for a, b in zip(at, at[1:])})

    def binned(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[f])).cast("array<double>"), lambda c: c <= F.col(f))).alias(f)

    bins = [binned(f) for f in FEATURES]
    counts = sample.select(F.col("fold").cast("int").alias("fold"), "bad", "times", *bins).groupBy("fold", "bad", *FEATURES).agg(F.sum("times").alias("n")).collect()
    forget(kept)
    x = np.array([[r[f] for f in FEATURES] for r in counts], int).reshape(-1, len(FEATURES))
    y = np.array([[r["fold"], r["bad"], r["n"]] for r in counts], int).reshape(-1, 3)
    order = np.lexsort((*x.T, *y.T))
    return cuts, x[order], y[order]


def cover(cuts: dict[str, list[float]], x: np.ndarray, y: np.ndarray, max_rules: int = 12, max_literals: int = 3, precision: float = 0.97, support: float = 0.002) -> DecisionList:
    """Sequential covering on counts: grow by information gain on folds 1 and 2, prune on fold 0, keep rules that hold ``precision`` on both."""
    out = DecisionList()
    if not len(y):
        return out
    tried = 0
    bad, n = y[:, 1] == 1, y[:, 2]
    prune = y[:, 0] == 1
    alive = np.ones(len(y), bool)
    least = max(2, support * n[bad].sum())

    def holds(rule: list[tuple[int, bool, int]]) -> np.ndarray:
        m = np.ones(len(y), bool)
        for f, above, b in rule:
            m &= (x[:, f] >= b) if above else (x[:, f] < b)
        return m

    def split(m: np.ndarray) -> tuple[int, int]:
        return int(n[m & bad].sum()), int(n[m & ~bad].sum())

    while len(out.rules) < max_rules and tried < 3 * max_rules:
        tried += 1
        rule: list[tuple[int, bool, int]] = []
        inside = alive & ~prune
        p, q = split(inside)
        while q and p and len(rule) < max_literals:
            best, gain = None, 0.0
            for f, name in enumerate(FEATURES):
                size = len(cuts[name]) + 1
                ps, qs = (np.bincount(x[m, f], n[m], size) for m in (inside & bad, inside & ~bad))
                for above in (True, False):
                    for b in range(1, size):
                        p1, q1 = (ps[b:].sum(), qs[b:].sum()) if above else (ps[:b].sum(), qs[:b].sum())
                        if p1 >= least / 2:
                            g = p1 * (np.log2(p1 / (p1 + q1)) - np.log2(p / (p + q)))
                            if g > gain + 1e-9:
                                best, gain = (f, above, b), g
            if best is None:
                break
            rule.append(best)
            inside &= holds([best])
            p, q = split(inside)
        worth = lambda r: (lambda a, b: (a - b) / (a + b) if a + b else -1)(*split(holds(r) & alive & prune))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        if not rule:
            break
        grown, pruned = split(holds(rule) & alive & ~prune), split(holds(rule) & alive & prune)
        if grown[0] < least / 2:
            break
        if min(grown[0] - precision * sum(grown), pruned[0] - precision * sum(pruned)) >= 0:
            out.rules.append([Literal(FEATURES[f], above, cuts[FEATURES[f]][b - 1]) for f, above, b in rule])
            alive &= ~holds(rule)
        else:  # not sure enough: its bad rows take no further part, so that other rules are tried
            alive &= ~(holds(rule) & bad)
    return out


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """The decision list from ``labels`` (doc_id, quality: 0 is rejected) over about ``sample_rows`` labelled rows."""
    return cover(*labelled_counts(docs, labels, sample_rows))


def judge(docs: DataFrame, rules: DecisionList, name: str) -> DataFrame:
    """Adds the struct ``name``: the statistics, base_failed, rule (0: none) and kept."""
    stats = free_name(docs, "stats")
    out = with_stats(docs, "text", stats)
    s = F.col(stats)
    fields = [s[f].alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    rule = rules.fired(features(s))
    return out.withColumn(name, F.struct(*fields, base_failed(s).alias("base_failed"), rule.alias("rule"), (~base_failed(s) & (rule == 0)).alias("kept"))).drop(stats)


def keep(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows that the rules keep, with the columns of ``docs``."""
    name = free_name(docs, "verdict")
    return judge(docs, rules, name).where(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
