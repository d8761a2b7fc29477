"""A training-data pipeline over `documents`: five stages, each one operator of quillon.llm.

Each stage takes (spark, docs, sf_dir), with docs what the stage before kept, written as Parquet and read
again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, lines, mixing, simhash, toxicity
from quillon.llm.common import materialize, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the training labels, scores below the threshold."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sources show; what only copies of one text show is left to the next stage."""
    return lines.strip(docs, copied=False).drop("n_lines", "n_removed")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash and pivots find them, links are exact (shingles of five words, similarity 0.8 or more)."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row's ids and of their decoding."""
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_boilerplate),
    ("simhash near-dedup", without_copies),
    ("mixing", mixed),
    ("byte-level bpe", tokens),
]

#: The stages hold a learned model and fingerprints, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
