"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes all rows that its predecessor kept. All but the last return the columns of
``documents``; the last adds shard. Stages are written as Parquet in the shared folder and read
again, so a lost executor costs no more than the stage it worked in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.llm import decontaminate, mixing, quality, sharding, simhash
from weblathe.llm.common import written

# One epoch: a document is used once or not at all.
RECIPE = mixing.Recipe(max_epochs=1, budget_percent=80)
SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules hold to be good."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in each leaf's share of the token budget."""
    return mixing.mix_documents(docs, RECIPE)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard."""
    return sharding.assign_shards(docs, "doc_id", SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing_to_weights", mixing_to_weights),
    ("shards", shards),
]

# The label model's expectation-maximisation and XXH64 are beyond DuckDB SQL; tests/llm holds the
# pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
