"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding, each on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import leaks, mixing, near_dups, quality, sharding
from claimweave.llm.common import made, read, removed, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near copies."""
    return near_dups.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return leaks.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixture(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix shuffled into 16 shards: the columns of documents, shard and slot."""
    return sharding.shuffled(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: The shuffle is drawn by a random generator that SQL does not have; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back; a stage's input and scratch files go once it is written."""
    docs, old = read(spark, sf_dir, "documents"), []
    for name, step in STAGES:
        with made() as paths:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        removed(spark, [*old, *paths[:-1]])
        old = paths[-1:]
    return docs
