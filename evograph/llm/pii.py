"""Personal data by weak supervision.

Four base kinds are found by fixed patterns. Beyond them, a wide pattern proposes
candidate spans, on which labelers vote for, against or not at all: shape (regular
expressions), check digits and ranges, gazetteers, and context words. The counts of the
vote patterns over all texts feed an expectation-maximisation that estimates how
reliable each labeler is; the resulting soft labels train a logistic span classifier on
counts by features of the span. Spans that it is sure of and that no base span touches
are added as kind ``other``.

Built-in column functions only: patterns with possessive loops (long texts cannot
overflow the stack), positions from the lengths between matches, models as column
expressions. What reaches the driver is counts by vote pattern or feature, whose number
is fixed.

Defined cases: null texts are empty and have no spans; rows that repeat an id are judged
each; kinds may overlap each other, spans of one kind do not; ties in start go in the
order of KINDS; empty tables give no rows and a classifier that adds nothing; texts of
any length and number of matches are searched whole; extra columns are kept by ``redact`` and never clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, running

KINDS = ("email", "ip", "card", "phone", "other")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Base patterns; each matches what its plain form matches, and starts only where a leftmost match can start.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of 14 to 19 digits with single spaces or hyphens between them
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without it has no span of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_GAP = "[^\\x20\\x09-\\x0D]"
CANDIDATE = rf"(?<!{_GAP})[^\x20\x09-\x0D@]*+@{_GAP}*+|(?<![0-9+])\+?[0-9][0-9\x20().-]{{4,}}[0-9]|(?<![A-Za-z0-9_=/+-])[A-Za-z0-9_=/+-]{{16,}}+"
#: Fixed values of the gazetteer and context labelers.
PLACES = r"(?i)(\.(com|org|net|edu|gov|info|io|de|fr|es|uk)\b|^(AKIA|ASIA|ghp_|xox[bp]-|sk-|AIza)|(key|token|secret|password|pass|pwd)=)"
CUES = r"(?i)(e-?mail|phone|tel|call|contact|address|card|visa|account|iban|ssn|passport|login|user|kontakt|telefon|anruf|adresse|courriel|appel|correo|llam|direcci)[^0-9@]{0,12}$"
AGAINST = r"(?i)(version|v\.|page|p\.|isbn|fig|vol|no\.|chapter|\$|€|£|%)[^0-9@]{0,4}$"
#: Added spans need at least this probability.
SURE = 0.9


def raw_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, match, before) of the matches, in code points; ``before``: up to 24 characters.

    Positions are running sums of the lengths of gaps and matches, so that the work grows
    with the number of matches n as n log n.
    """
    empty = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")

    def place(gaps: Column, found: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m))

        def spans(ends: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                end = F.get(ends, i)
                return F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("match"), F.right(F.get(gaps, i), F.lit(24)).alias("before"))

            return F.transform(found, one)

        return let(steps, lambda n: let(running(n, lambda a, b: a + b), spans))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda m: F.when(F.size(m) == 0, empty).otherwise(let(F.split(text, pattern, -1), lambda g: place(g, m))))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def one(i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    places = F.sequence(F.lit(0), F.char_length(digits) - 1)
    return (F.char_length(digits) > 0) & (F.aggregate(F.when(F.char_length(digits) > 0, places).otherwise(F.array().cast("array<int>")), F.lit(0), lambda a, i: a + one(i)) % 10 == 0)


def small_parts(m: Column) -> Column:
    """Four parts of at most 255, leading zeros allowed."""
    plain = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, "\\."), lambda p: F.when(F.char_length(plain(p)) > 3, F.lit(False)).otherwise(F.concat(F.lit("0"), plain(p)).cast("int") <= 255))


def valid(kind: str, m: Column) -> Column:
    n = F.char_length(digits_of(m))
    return {"email": F.lit(True), "ip": small_parts(m), "card": n.between(14, 19) & luhn(digits_of(m)), "phone": n.between(10, 15)}[kind]


def base_spans(text: Column, kind: str) -> Column:
    """(start, end, kind as number) of a base kind."""
    kept = F.filter(raw_spans(text, PATTERNS[kind]), lambda s: valid(kind, s["match"]))
    plain = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))
    possible = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9][\\x20-]?[0-9]")
    return F.when(possible, plain).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def candidates(text: Column) -> Column:
    """Candidate spans: tokens with an at sign, numbers of six or more characters, long mixed tokens."""
    found = F.filter(raw_spans(text, CANDIDATE), lambda s: s["match"].rlike("[0-9@]"))
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast("array<struct<start:int,end:int,match:string,before:string>>"))


def votes(m: Column, before: Column) -> dict[str, Column]:
    """Votes of the labelers on a candidate: 1 for, -1 against, 0 none."""
    digits, n = digits_of(m), F.char_length(digits_of(m))
    shaped = [m.rlike(f"^(?:{PATTERNS[k]})$") for k in PATTERNS]
    # a bare run of digits has no shape of its own
    any_shape = shaped[0] | shaped[1] | ((shaped[2] | shaped[3]) & m.rlike("[^0-9]")) | m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    number = m.rlike("^[+0-9\\x20().-]+$")
    return {
        "shape": F.when(any_shape, 1).when(m.rlike("^[0-9]{1,4}([./-][0-9]{1,4}){1,2}$"), -1).otherwise(0),
        "check": F.when(m.rlike("^[0-9]+(\\.[0-9]+){3}$"), F.when(small_parts(m), 1).otherwise(-1)).when(number & n.between(14, 19), F.when(luhn(digits), 1).otherwise(-1)).when(number & (n < 7), -1).otherwise(0),
        "place": F.when(m.rlike(PLACES), 1).when(m.startswith("+"), 1).otherwise(0),
        "context": F.when(before.rlike(CUES), 1).when(before.rlike(AGAINST), -1).otherwise(0),
    }


LABELERS = ("shape", "check", "place", "context")


def traits(m: Column, before: Column) -> dict[str, Column]:
    """Features of a candidate for the final classifier, each of a few whole numbers."""
    n, size = F.char_length(digits_of(m)), F.char_length(m)
    return {
        "size": F.least(F.floor(size / 4), F.lit(9)).cast("int"), "digits": F.least(n, F.lit(20)).cast("int"), "share": F.floor(4 * n / F.greatest(size, F.lit(1))).cast("int"),
        "at": F.contains(m, F.lit("@")).cast("int"), "plus": m.startswith("+").cast("int"), "dots": F.least(F.size(F.split(m, "\\.")) - 1, F.lit(4)).cast("int"),
        "letters": m.rlike("[A-Za-z]").cast("int"), "cue": before.rlike(CUES).cast("int"), "place": m.rlike(PLACES).cast("int"),
        "check": votes(m, before)["check"].cast("int"),
    }


TRAITS = ("size", "digits", "share", "at", "plus", "dots", "letters", "cue", "place", "check")


@dataclass
class Model:
    """Reliability of each labeler's votes, and the classifier's weights by trait value."""

    reliability: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    weights: dict[str, dict[int, float]] = field(default_factory=dict)

    def probability(self, m: Column, before: Column) -> Column:
        z = F.lit(self.bias)
        for name, value in traits(m, before).items():
            by = self.weights.get(name)
            if by:
                pick = None
                for v, w in sorted(by.items()):
                    pick = F.when(value == v, w) if pick is None else pick.when(value == v, w)
                z = z + pick.otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def aggregate_votes(patterns: np.ndarray, n: np.ndarray, rounds: int = 200, prior: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Accuracy of each labeler's votes and posterior of each vote pattern, by expectation-maximisation over counts.

    Whether a labeler votes says nothing, only how: else the classes would settle on kinds
    of spans (labelers vote on some kinds only). Accuracies have a Beta(8, 2) prior, so
    that the classes cannot swap; the prior is fixed, and a pattern without votes stays there.
    """
    voted, yes = patterns != 0, patterns == 1
    accuracy = np.full(patterns.shape[1], 0.8)
    post = np.full(len(patterns), prior)
    for _ in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        z = np.log(prior / (1 - prior)) + (np.where(yes, odds, -odds) * voted).sum(1)
        new = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        right = np.where(yes, new[:, None], 1 - new[:, None]) * voted
        accuracy = np.clip(((right * n[:, None]).sum(0) + 8) / ((voted * n[:, None]).sum(0) + 10), 0.55, 0.999)
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return accuracy, post


def learn(docs: DataFrame) -> Model:
    """Model from the candidates of all texts; only counts by vote pattern and by traits reach the driver."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.select(F.explode(candidates(text)).alias("s"))
    m, before = F.col("s")["match"], F.col("s")["before"]
    cols = [c.cast("int").alias(f"v_{k}") for k, c in votes(m, before).items()] + [c.alias(f"t_{k}") for k, c in traits(m, before).items()]
    # the traits and votes take few values each: the counts are bounded whatever the texts
    rows = spans.select(*cols).groupBy(*[f"v_{k}" for k in LABELERS], *[f"t_{k}" for k in TRAITS]).count().collect()
    if not rows:
        return Model()
    rows = sorted(rows)
    v, x = np.array([r[: len(LABELERS)] for r in rows], int), np.array([r[len(LABELERS) : -1] for r in rows], int)
    n = np.array([r[-1] for r in rows], float)
    patterns, which = np.unique(v, axis=0, return_inverse=True)
    accuracy, post = aggregate_votes(patterns, np.bincount(which.ravel(), n))
    y = post[which.ravel()]
    one_hot = [(f, int(u)) for f in range(len(TRAITS)) for u in np.unique(x[:, f])]
    a = np.stack([np.ones(len(x)), *[(x[:, f] == u).astype(float) for f, u in one_hot]], 1)
    w = np.zeros(a.shape[1])
    for _ in range(60):  # Newton steps of the ridge logistic loss with soft labels
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + np.eye(len(w)), a.T @ (n * (y - p)) - w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    weights: dict[str, dict[int, float]] = {}
    for (f, u), value in zip(one_hot, w[1:]):
        weights.setdefault(TRAITS[f], {})[u] = float(value)
    return Model(dict(zip(LABELERS, accuracy.tolist())), float(w[0]), weights)


def with_spans(docs: DataFrame, model: Model, name: str, sure: float = SURE) -> DataFrame:
    """Adds the struct ``name``: base (spans of the four kinds) and spans (all), sorted by start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.sort_array(F.concat(*[base_spans(text, k) for k in KINDS[:4]]))
    if model.weights:
        likely = F.filter(candidates(text), lambda s: model.probability(s["match"], s["before"]) >= sure)
        more = F.transform(likely, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("other")).alias("kind"), s["end"].alias("end")))
    else:
        more = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def both(b: Column) -> Column:
        return F.struct(b.alias("base"), let(more, lambda c: F.when(F.size(c) == 0, b).otherwise(F.sort_array(F.concat(b, untouched(b, c))))).alias("spans"))

    return docs.withColumn(name, let(base, both))


def untouched(base: Column, more: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``: a sweep over the starts of ``base`` and the ends of ``more``.

    A span of ``more`` is free when no base span that starts before its end ends behind
    its start: the running maximum of base ends, read where the span's end sorts, tells.
    """
    opens = F.transform(base, lambda t: F.struct(t["start"].alias("at"), F.lit(1).alias("side"), t["end"].alias("reach"), t.alias("span")))
    asks = F.transform(more, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("side"), F.lit(-1).alias("reach"), s.alias("span")))

    def swept(events: Column) -> Column:
        def free(reach: Column) -> Column:
            kept = F.filter(events, lambda e, i: (e["side"] == 0) & (F.get(reach, i) <= e["span"]["start"]))
            return F.transform(kept, lambda e: e["span"])

        return let(running(F.transform(events, lambda e: e["reach"]), F.greatest), free)

    return let(F.sort_array(F.concat(opens, asks)), swept)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of the blocks that a text is read by when parts of it are cut out.
CHUNK = 512


def redact(docs: DataFrame, model: Model, sure: float = SURE) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; n_chars, where there is one, follows.

    The text is split once into blocks of CHUNK characters, so that cutting out a part
    costs its own length and a block, wherever it lies.
    """
    s = free_name(docs, "spans")
    found = with_spans(docs, model, s, sure)
    text, spans = F.col("text"), F.col(s)["spans"]
    tag = lambda x: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)), F.lit("]"))

    def part(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / CHUNK).cast("int")
        some = F.slice(blocks, first + 1, F.greatest(F.floor((b - 1) / CHUNK).cast("int") - first + 1, F.lit(0)))
        return F.when(a >= b, F.lit("")).otherwise(F.substring(F.array_join(some, ""), a - first * CHUNK + 1, b - a))

    def replaced(blocks: Column) -> Column:
        def pieces(reach: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                at = F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
                # a span that starts inside what is replaced already only widens it
                return F.when(x["start"] < at, F.lit("")).otherwise(F.concat(part(blocks, at, x["start"]), tag(x)))

            rest = part(blocks, F.element_at(reach, -1), F.char_length(text))
            return F.concat(F.array_join(F.transform(spans, one), ""), rest)

        return let(running(F.transform(spans, lambda x: x["end"]), F.greatest), pieces)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    clean = F.when(F.size(spans) == 0, text).otherwise(let(blocks, replaced))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
