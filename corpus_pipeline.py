"""From raw documents to shards for training: five stages, each over all that the one before kept.

run(spark, sf_dir) applies STAGES to the table `documents`; each stage's rows are
written as Parquet to the shared folder and read again. All stages but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corbel.llm import decontam, jaccard, mixing, quality, sharding
from corbel.llm.common import scratch, staged


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, trained on `labels`, don't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of `benchmark`."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, or repeated up to three times."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, 0 to 23, of near equal bytes."""
    return sharding.sharded(docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each_group), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: The quality rules are learned, which SQL can't express; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as outer:  # what a stage has staged for itself goes once its rows are written
            docs = staged(stage(spark, docs, sf_dir), f"stage-{name}", scope=outer)
    return docs
