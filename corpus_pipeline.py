"""From raw documents to packed sequences: quality, exact and near duplicates, mix, packing.

Every stage takes all that the one before kept and returns the columns of documents; the last
returns the pieces of the packed sequences. ``run`` writes each stage's result as Parquet in the
shared folder and reads it again, so that a lost executor costs a stage at most.

A null text is an empty one; the quality rules reject texts of fewer than 20 words, so neither goes
further. A null source is a source, weighed last. Rows that repeat an id, or have none, are rows of their
own; of equal or near texts the longest or first stays, as the operators state. An empty table gives no
pieces. Other columns, whatever their names, are kept up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetviews.llm import common, exact_dedup, mixing, packing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Thresholds from sketches, fingerprints and packing have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
