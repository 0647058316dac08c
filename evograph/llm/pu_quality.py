"""Quality classifier by positive-unlabelled learning.

Trusted positives (labelled 1, not held out) and unlabelled texts are the only training
data; labels 0 are never looked at. Text statistics, computed by built-in column
functions, are binned, and a logistic model over bins and pairs of bins minimises the
non-negative unbiased risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

by full gradient steps. The class prior of the unlabelled texts is estimated as the
median ratio, over the top regions of a first positive-against-unlabelled score, of the
unlabelled mass to the positive mass on rows that score has not seen. Last, the bias is
set so that all but MISSED of the trusted positives reach the score that counts as good:
the prior fixes the risk, the positives alone the operating point. The model is written
out as one column expression.

Defined cases: null and empty texts are scored like texts of no words; without trusted
positives every score is 0, without unlabelled texts all training texts serve as such;
rows that repeat an id are scored each; empty tables give no rows; extra columns are
not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, held_out, let, stored, words_of

#: Positives and unlabelled rows that are learned from at most, by hash of the id.
POSITIVES, UNLABELLED = 10_000, 20_000
#: Share of the trusted positives that may fall below GOOD, and the number of positives with which half of that shift is made.
MISSED, GOOD, HALF = 0.005, 0.7, 400
#: Quantiles of all rows at which the bins are cut.
POINTS = (0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.96, 0.98, 0.99)
FEATURES = ("size", "distinct", "mean_length", "symbols", "upper", "shout", "lines", "digits")
#: Pairs of features whose bins are crossed.
CROSSED = (("size", "distinct"), ("size", "symbols"))


def with_features(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the array column ``name`` of FEATURES, as doubles."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def values(w: Column) -> Column:
        n, chars = F.greatest(F.size(w), F.lit(1)), F.greatest(F.char_length(whole), F.lit(1))
        count = lambda pattern: F.regexp_count(whole, F.lit(pattern))
        # distinct words among n follow about c * n**0.8 in running text: this takes out most of the length
        parts = [
            F.log1p(F.size(w)), F.size(F.array_distinct(w)) / F.pow(n.cast("double"), F.lit(0.8)), F.char_length(F.array_join(w, "")) / n, count("[#*$%&|<>=_~^]") / n,
            count("\\p{Lu}") / chars, count("[!?]") / n, count("\\n") / n, count("[0-9]") / chars,
        ]
        return F.array(*[p.cast("double") for p in parts])

    return df.withColumn(name, let(words_of(F.col(text)), values))


@dataclass
class Model:
    """Cuts and weights by feature, weights by pair of bins, bias; ``prior`` as estimated."""

    cuts: list[list[float]]
    single: list[list[float]]
    crossed: list[list[float]]
    bias: float
    prior: float

    def probability(self, x: Column) -> Column:
        if not self.cuts:
            return F.lit(0.0)
        at = F.array(*[self._bin(x, f) for f in range(len(FEATURES))])

        def total(b: Column) -> Column:
            out = F.lit(self.bias)
            for f, w in enumerate(self.single):
                out = out + F.get(F.array(*map(F.lit, w)), b[f])
            for (f, g), w in zip(CROSSED, self.crossed):
                i, j = FEATURES.index(f), FEATURES.index(g)
                out = out + F.get(F.array(*map(F.lit, w)), b[i] * (len(self.cuts[j]) + 1) + b[j])
            return 1 / (1 + F.exp(-out))

        return let(at, total)

    def _bin(self, x: Column, f: int) -> Column:
        if not self.cuts[f]:
            return F.lit(0)
        value = x[f]
        return sum((F.when(value >= c, 1).otherwise(0) for c in self.cuts[f][1:]), F.when(value >= self.cuts[f][0], 1).otherwise(0))


def _indices(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Column numbers of the bins and crossed bins of each row in one long weight vector."""
    at = np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)], 1)
    cols, start = [], 0
    for f, c in enumerate(cuts):
        cols.append(start + at[:, f])
        start += len(c) + 1
    for f, g in CROSSED:
        i, j = FEATURES.index(f), FEATURES.index(g)
        cols.append(start + at[:, i] * (len(cuts[j]) + 1) + at[:, j])
        start += (len(cuts[i]) + 1) * (len(cuts[j]) + 1)
    return np.stack(cols, 1)


def _descend(grad, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam with full gradients."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(p: np.ndarray, u: np.ndarray, steps: int = 800, ridge: float = 2e-4) -> Model:
    """Non-negative unbiased risk minimisation over positives ``p`` and unlabelled ``u``."""
    both = np.concatenate([p, u])
    # finer towards both ends, and where the positives thin out: negatives gather there
    cuts = [sorted({float(v) for v in (*np.quantile(both[:, f], POINTS), *np.quantile(p[:, f], (0.001, 0.005, 0.02, 0.98, 0.995, 0.999)))}) for f in range(len(FEATURES))]
    cuts = [[c for c in cs if c > both[:, f].min()] for f, cs in enumerate(cuts)]
    ip, iu = _indices(p, cuts), _indices(u, cuts)
    size = sum(len(c) + 1 for c in cuts) + sum((len(cuts[FEATURES.index(f)]) + 1) * (len(cuts[FEATURES.index(g)]) + 1) for f, g in CROSSED) + 1

    def z(w: np.ndarray, i: np.ndarray) -> np.ndarray:
        return w[i].sum(1) + w[-1]

    def spread(c: np.ndarray, i: np.ndarray) -> np.ndarray:
        out = np.bincount(i.ravel(), np.repeat(c, i.shape[1]), size)
        out[-1] = c.sum()
        return out

    s = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    # one half of the rows learns a first score, the other half measures the regions
    order = np.random.default_rng(3)
    mp, mu = order.random(len(ip)) < 0.5, order.random(len(iu)) < 0.5
    if min(mp.sum(), (~mp).sum(), mu.sum(), (~mu).sum()) == 0:
        mp, mu = np.ones(len(ip), bool), np.ones(len(iu), bool)
    tp, tu, vp, vu = ip[mp], iu[mu], ip[~mp] if (~mp).any() else ip, iu[~mu] if (~mu).any() else iu

    def first(w: np.ndarray) -> np.ndarray:  # positives against unlabelled
        return spread((s(z(w, tp)) - 1) / len(tp), tp) + spread(s(z(w, tu)) / len(tu), tu) + ridge * w

    w = _descend(first, size, steps // 2)
    zp, zu = z(w, vp), z(w, vu)
    tops = [np.quantile(zp, q) for q in np.linspace(0.1, 0.5, 9)]
    ratios = []
    for t in tops:
        hp, hu = max((zp >= t).mean(), 1e-9), (zu >= t).mean()
        error = np.sqrt(hu * (1 - hu) / len(zu)) / hp + hu / hp * np.sqrt(hp * (1 - hp) / len(zp)) / hp
        ratios.append(hu / hp - error)  # one standard error less: too high a prior hides the negatives
    prior = float(np.clip(np.median(ratios), 0.05, 0.98))

    def risk(w: np.ndarray) -> np.ndarray:
        gp, gu = s(z(w, ip)), s(z(w, iu))
        loss = lambda x: np.logaddexp(0, x).mean()
        negative = loss(z(w, iu)) - prior * loss(z(w, ip))
        plus = spread(prior * (gp - 1) / len(ip), ip)
        minus = spread(gu / len(iu), iu) - spread(prior * gp / len(ip), ip)
        return (plus + minus if negative >= 0 else -minus) + ridge * w

    w = _descend(risk, size, steps)
    # few positives score higher in training than new ones do: the shift shrinks with their number
    w[-1] += len(ip) / (len(ip) + HALF) * (np.log(GOOD / (1 - GOOD)) - np.quantile(z(w, ip), MISSED))
    single, crossed, at = [], [], 0
    for c in cuts:
        single.append(w[at : at + len(c) + 1].tolist())
        at += len(c) + 1
    for f, g in CROSSED:
        k = (len(cuts[FEATURES.index(f)]) + 1) * (len(cuts[FEATURES.index(g)]) + 1)
        crossed.append(w[at : at + k].tolist())
        at += k
    return Model(cuts, single, crossed, float(w[-1]), prior)


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Model from trusted positives (quality 1, not held out) and texts without a label, bounded as documented."""
    docs = docs.select("doc_id", "text")
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    good = known.where("quality = 1").select("doc_id").distinct()
    n_good, n_docs, n_known = good.count(), docs.count(), labels.select("doc_id").count()
    if not n_good:
        return Model([], [], [], 0.0, 0.0)
    part = lambda c, k, n: F.pmod(F.xxhash64(c, F.lit(4)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, k / max(n, 1)))
    # about ``positives`` ids: bounded, so they may be sent to every executor
    p = docs.join(F.broadcast(good.where(part("doc_id", positives, n_good))), "doc_id")
    thinned = docs.where(part("doc_id", 2 * unlabelled, max(n_docs - n_known, 1))).where(~held_out(F.col("doc_id")))
    ids = stored(thinned.select("doc_id").join(labels.select(F.col("doc_id").alias("l")).distinct(), F.col("doc_id") == F.col("l"), "left_anti").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(unlabelled), "unlabelled")
    if ids.isEmpty():
        ids = stored(thinned.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(unlabelled), "unlabelled")
    u = docs.join(F.broadcast(ids), "doc_id")  # bounded by ``unlabelled``
    both = p.select("text", F.lit(1).alias("p")).unionAll(u.select("text", F.lit(0).alias("p")))
    rows = with_features(both, "text", "x").select("x", "p").collect()  # bounded samples of eight numbers
    forget(ids)
    x = {k: np.array(sorted(r["x"] for r in rows if r["p"] == k), float).reshape(-1, len(FEATURES)) for k in (0, 1)}
    return fit(x[1], x[0]) if len(x[0]) and len(x[1]) else Model([], [], [], 0.0, 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (probability of quality 1) of every whole text."""
    x = free_name(docs, "features")
    out = with_features(docs.select("doc_id", "text"), "text", x)
    return out.select("doc_id", model.probability(F.col(x)).alias("score"))
