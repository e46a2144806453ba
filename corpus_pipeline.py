"""Corpus pipeline: good documents, one of each near-duplicate group, without benchmark passages, mixed and sharded.

Every stage works on all rows its predecessor kept, and is written before the next one reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from outagelab.llm import decontaminate, mix, quality, shards, simhash
from outagelab.sources.sinks import stage_root


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on labelled rows outside the held-out fold."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group whose SimHash fingerprints link up."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of words with a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mix draws, a row for each time; their length is counted anew."""
    return mix.mix(docs, chars_col="n_chars").select(docs.columns)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every mixed row."""
    return shards.assignments(shards.shard(docs))


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix_to_weights", mix_sources),
    ("sharding", cut_shards),
]

# Hash functions, a fitted model and seeded permutations have no counterpart in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written as Parquet and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{stage_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, work) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
