"""Corpus pipeline: quality rules, near-dedup, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``docs``.

Defined cases: a null text has no words, so the rules reject it, as they do empty ones; a
null id is no near copy of anything and is kept; repeated rows of one id and text are one
document after near-dedup; very long texts are read whole by every stage; ties go to the
smaller id, or to whole classes of sizes in the mix; empty tables give no rows; columns
beyond those named here are kept until packing, and never clash with work columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evograph.llm import mixing, near_dedup, packing, pii, quality_rules
from evograph.llm.common import forget, stored, table
from evograph.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, learned from the labels, keep."""
    return quality_rules.keep(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep(docs, n=5, percent=80)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return pii.redact(docs, pii.learn(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.mix(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", rules_stage),
    ("near-dedup", dedup_stage),
    ("personal data", personal_data_stage),
    ("source mix", mix_stage),
    ("packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        forget(before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # its result is written: it reads the documents no more
    forget(docs)
    return out


#: SQL can express neither learned rules nor the tokenizer.
ORACLE_SQL: str | None = None
