"""A training-data pipeline over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before kept; results are written as Parquet and read again between stages.
All stages but the last return the columns of ``documents``.

Defined results, for any table with the columns of ``documents``: null and
empty texts are documents like others (one of them stays in exact dedup, all
have fingerprint zero, they hold no words to mix, and encode to no ids); null
ids and sources are values of their own; rows identical in every column count
as one where one of a group must stay, and where it ties the smallest id, null
last, wins; long texts are read whole; further columns are carried along,
whatever their names; an empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ranksmith.llm import exact_dedup, mixing, simhash, toxicity
from ranksmith.llm.common import read, staged
from ranksmith.llm.queries import bpe_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.not_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints stays."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and decoded text."""
    return bpe_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Toxicity and near copies have no SQL form; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
