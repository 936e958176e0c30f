"""From documents to token ids: language, near copies, benchmark leaks, mixture, output.

Each stage works on all that the one before it kept and returns the columns of
documents; the last returns one row per document of the written token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliolake.llm import decontaminate, langid, minhash, mixing
from foliolake.llm.queries import table, token_output
from foliolake.llm.scratch import Scratch
from foliolake.session import importable

#: The share of a text that its language must make up. Short documents with a line in another language are clean.
LEAST_SCORE = 1 / 3
#: What is left of the toxic domain's expected tokens; the other domains keep theirs.
TOXIC_SHARE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which a third or more is in one learned language; texts without a letter go too."""
    return langid.accepted(docs, langid.learn(docs), least_score=LEAST_SCORE)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by a similarity of 0.8 on five-word shingles."""
    return minhash.keep_first(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins out the toxic domain by fitted rates, rounded by chance; the other domains keep their expected tokens."""

    def targets(now: dict[str, float]) -> dict[str, float]:
        return {d: n * (TOXIC_SHARE if d == "toxic" else 1.0) for d, n in now.items()}

    return mixing.mixed(docs, table(spark, sf_dir, "labels"), targets)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids of all texts and reads one row per document back."""
    return token_output(spark, docs)


STAGES = [
    (name, lambda spark, docs, sf_dir, stage=stage: stage(importable(spark), docs, sf_dir))
    for name, stage in [("language_id", language_id), ("minhash_dedup", minhash_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing), ("token_ids", token_ids)]
]

#: SQL can express neither the fitted models nor the tokenizer; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
