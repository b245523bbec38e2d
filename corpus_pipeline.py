"""A training-corpus pipeline: toxicity, near-duplicates, benchmark leaks, source mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablemill.llm import decontam, mixing, similar, tokens, toxicity
from tablemill.llm.common import written
from tablemill.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression, fitted on a sample of ``labels``, takes for clean."""
    return toxicity.remove_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are alike by 0.8 or more, the one with the smallest doc_id.

    SimHash and multi-index hashing link close copies, verified on whole sets; prefix filtering finds the links they miss.
    """
    return similar.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: each document as often as the mix takes it."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards of the mix, and where each document's ids are, read back from them."""
    return tokens.op10(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token ids", token_ids),
]

#: A trained model decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
