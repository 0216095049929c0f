"""The corpus pipeline: five stages, each one operator of the llm subpackage.

run(spark, sf_dir) applies STAGES to documents; each stage's rows are written as Parquet in the shared
folder and read again as the next one's. All stages but the last return the columns of documents.

Empty tables, null texts and further columns pass through as each operator defines it: language ID drops
texts that are null or have no letter; the others treat a null text as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, language, mixing, packing, secrets
from tidemark.llm.common import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that aren't held out; documents whose language is unknown go."""
    return language.keep_known(docs, language.fit(docs.where(~language.held_out())))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: the smallest doc_id of each component stays."""
    return jaccard.one_of_each(docs, 5, 80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by the square roots of their sizes, as Poisson counts."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL: the trained language model, the Markov models and the tokenizer can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
