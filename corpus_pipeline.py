"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Language identification rejects documents without a language; SimHash keeps one document of each
group of near copies; decontamination drops documents into which a benchmark item leaks; mixing
repeats or leaves out documents so that sources meet their targets; sharding places every row,
which keeps its columns and gains shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import common, decontamination, langid, mixing, sharding, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(spark, docs, common.read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs, common.staged(mixing.mix(docs), "mixed"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: No SQL expresses EM, tiling or the cube method; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return docs
