"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lower-cases, maps homoglyphs and digit or sign substitutions to plain letters,
drops combining marks and turns everything else into single spaces. The lexicon holds
all words that are significantly more frequent in toxic training documents, weighted by
smoothed log odds; exception phrases are word pairs around a lexicon word that occur
almost only in clean ones, and cancel the hits inside them. The score is a logistic
function, fitted on the same sample, of the weights found, as they are and per word.

Defined cases: null and empty texts have no hits and score as such; with no labels or
one class the score is the share of toxic labels (0 without any); labels that repeat and
copies of a text count once; rows that repeat an id are scored each; empty tables give no rows; extra
columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, held_out, stored

#: Labelled rows that are learned from at most, by hash of the id.
SAMPLE_ROWS = 20_000
#: Letters of a stem: the lexicon may hold stems, written with a star, which match any longer word.
STEM = 5
#: Letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "£": "l",
}


class _Fold(dict):
    """Code point to folded text, filled as code points turn up; at most one entry for each code point."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        plain = "".join(HOMOGLYPHS.get(x, x) for x in plain)
        self[code] = out = plain if plain.isalnum() else "" if unicodedata.combining(c) else " "
        return out


_fold = _Fold()


def fold(text: str | None) -> str:
    """Folded words, with one space before, between and after them."""
    # a mark that ends a sentence stays a space; inside a word it stands for its letter
    words = (w.rstrip("!@$") for w in (text or "").split())
    return f" {' '.join(' '.join(words).translate(_fold).split())} "


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    weights: tuple[float, float, float, float] = (-30.0, 0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for w, weight in self.lexicon.items():
            out.add_word(f" {w[:-1]}" if w.endswith("*") else f" {w} ", (len(w) + (0 if w.endswith("*") else 2), weight))
        for p in self.exceptions:
            out.add_word(f" {p} ", (len(p) + 2, None))
        if len(out):
            out.make_automaton()
        return out


def hits(folded: str, automaton: ahocorasick.Automaton) -> tuple[int, float]:
    """Number and total weight of the hits that no exception phrase covers."""
    if not len(automaton):
        return 0, 0.0
    found = [(end - n + 1, end, w) for end, (n, w) in automaton.iter(folded)]
    if not found:
        return 0, 0.0
    free = [(a, b) for a, b, w in found if w is None]
    ends = {}
    for a, b in free:
        ends[a] = max(b, ends.get(a, b))
    total, n, at, cover = 0.0, 0, 0, -1
    spans = sorted(ends.items())
    best: dict[int, tuple[int, float]] = {}  # a word and its stem begin at one place: the heavier counts
    for a, b, w in found:
        if w is not None and (a not in best or w > best[a][1]):
            best[a] = b, w
    for a, (b, w) in sorted(best.items()):
        while at < len(spans) and spans[at][0] <= a:
            cover = max(cover, spans[at][1])
            at += 1
        if b > cover:
            n, total = n + 1, total + w
    return n, total


def measures(n_words: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Columns of the logistic function: 1, weight found, weight for each 100 words, any hit."""
    return np.stack([np.ones(len(n)), np.log1p(total), np.minimum(100 * total / np.maximum(n_words, 1), 50), (n > 0).astype(float)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from the labels (doc_id, toxic) of rows that aren't held out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / max(total, 1)
        return Model(weights=(30.0 * (2 * share - 1), 0.0, 0.0, 0.0))
    if total > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    # about sample_rows rows of an id and a flag: bounded, so it may be sent to every executor
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic").distinct(), "toxicity-sample")
    n = dict.fromkeys((0, 1), 0)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = set(fold(text).split())
                by[toxic].update(words | {f"{w[:STEM]}*" for w in words if len(w) > STEM} | {""})
        keys = [*by[0].keys() | by[1].keys()]
        yield pd.DataFrame({"term": keys, "clean": [by[0][k] for k in keys], "toxic": [by[1][k] for k in keys]})

    terms = sample.mapInPandas(frequencies, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    terms = stored(terms.where("toxic >= 2 or term = ''"), "terms")
    whole = terms.where("term = ''").first()
    n = {0: whole["clean"], 1: whole["toxic"]} if whole else n
    if not n[0] or not n[1]:
        return Model(weights=(30.0 * (2 * n[1] / max(n[0] + n[1], 1) - 1), 0.0, 0.0, 0.0))
    rate_t, rate_c = F.col("toxic") / n[1], F.col("clean") / n[0]
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    mean = (F.col("toxic") + F.col("clean") + 1) / (n[0] + n[1])
    sure = (rate_t - rate_c) / F.sqrt(mean * (1 / n[0] + 1 / n[1]))
    best = terms.where("term <> ''").select("term", odds.alias("odds"), sure.alias("sure")).where("odds >= 1.5 and sure >= 4")
    lexicon = {r["term"]: r["odds"] for r in best.collect()}  # terms of the sample that pass: bounded by it
    if not lexicon:
        return Model(weights=(float(np.log(n[1] / n[0])), 0.0, 0.0, 0.0))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = fold(text).split()
                by[toxic].update({f"{a} {b}" for a, b in zip(words, words[1:]) if {a, b, f"{a[:STEM]}*", f"{b[:STEM]}*"} & lexicon.keys()})
        keys = [*by[0].keys() | by[1].keys()]
        yield pd.DataFrame({"term": keys, "clean": [by[0][k] for k in keys], "toxic": [by[1][k] for k in keys]})

    around = sample.mapInPandas(pairs, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    around = around.where("clean >= 5 and clean >= 20 * toxic")
    model = Model(lexicon, sorted(r["term"] for r in around.collect()))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for batch in batches:
            found = [(f.count(" ") - 1, *hits(f, automaton)) for f in map(fold, batch["text"])]
            yield pd.DataFrame({"n_words": [x[0] for x in found], "n": [x[1] for x in found], "total": [x[2] for x in found], "toxic": batch["toxic"].to_numpy()})

    got = sorted(sample.mapInPandas(measured, "n_words long, n long, total double, toxic long").collect())  # bounded by the sample
    forget(sample, terms)
    x = np.array([[r["n_words"], r["n"], r["total"]] for r in got], float)
    w = _logistic(measures(x[:, 0], x[:, 1], x[:, 2]), np.array([r["toxic"] for r in got], float))
    return Model(lexicon, model.exceptions, tuple(float(v) for v in w))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_hits and score of every whole text of (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, w = model.automaton(), np.array(model.weights)
        for batch in batches:
            found = np.array([(f.count(" ") - 1, *hits(f, automaton)) for f in map(fold, batch["text"])], float).reshape(-1, 3)
            z = np.clip(measures(found[:, 0], found[:, 1], found[:, 2]) @ w, -30, 30)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_hits": found[:, 1].astype(np.int64), "score": 1 / (1 + np.exp(-z))})

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text: a null id must not turn numbers into floats
    return texts.mapInPandas(run, "doc_id string, n_hits long, score double").select(F.col("doc_id").cast("long").alias("doc_id"), "n_hits", "score")
