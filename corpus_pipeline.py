"""From raw documents to packed sequences: quality, near-duplicates, privacy, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again for the next one. All but the last return the columns of ``documents``. An
empty table passes through every stage; how a stage treats nulls, long texts, ties and
repeated rows is said at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runassay.llm import mixing, near_dups, packing, privacy, quality
from runassay.llm.common import pin

#: Share of common word shingles from which on documents are near-duplicates here; op8 asks for 85.
NEAR_DUPLICATE_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return near_dups.drop_near_duplicates(docs, NEAR_DUPLICATE_PERCENT)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it replaced; ``n_chars`` follows the new text."""
    return privacy.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn towards the target weights, each once at most."""
    return mixing.sampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece with its sequence and place."""
    return packing.pack_min_slack(docs)


STAGES = [
    ("quality rules", good_quality),
    ("near-duplicates", one_of_each),
    ("personal data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL cannot express the signatures, the tokens or the packing; tests use plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
