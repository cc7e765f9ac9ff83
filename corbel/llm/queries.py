"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, jaccard, linehash, mixing, pii, quality, sharding, tokens, topk, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1_rows(_table(spark, sf_dir, "documents"))


def op2_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op2_rows(_table(spark, sf_dir, "documents"))


def op3_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op3_rows(_table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.op4_rows(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op5_rows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6_rows(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op7_rows(_table(spark, sf_dir, "documents"))


def op8_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linehash.op8_rows(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9_rows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.op10_rows(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pareto_mix, op2_differencing_shards, op3_block_top_k, op4_token_counts, op5_decontamination, op6_personal_data, op7_jaccard_join, op8_line_hashing, op9_quality_rules, op10_line_winnowing)}

SQL: dict[str, str] = {"op1_pareto_mix": mixing.OP1_SQL, "op3_block_top_k": topk.OP3_SQL, "op5_decontamination": decontam.OP5_SQL, "op7_jaccard_join": jaccard.OP7_SQL, "op8_line_hashing": linehash.OP8_SQL, "op10_line_winnowing": winnow.OP10_SQL}
