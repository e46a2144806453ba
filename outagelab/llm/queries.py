"""One query per corpus operator, over the whole of its table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate, embeddings, exact, licenses, lines, manifest, mix, quality, shards, simhash, sql, substrings, suffixes, trie,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = decontaminate.find_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(spans)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.taken(mix.draw(_table(spark, sf_dir, "documents")))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assignments(shards.shard(_table(spark, sf_dir, "documents")))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(_table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.find_repeats(_table(spark, sf_dir, "documents")))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.find_repeats(_table(spark, sf_dir, "documents")))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.remove_boilerplate(_table(spark, sf_dir, "documents")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(_table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampered_proofs(_table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(_table(spark, sf_dir, "documents"), digests=True)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.sequences(_table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix_sources": op2_mix_sources,
    "op3_shard": op3_shard,
    "op4_embeddings": op4_embeddings,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_suffixes": op7_suffixes,
    "op8_substrings": op8_substrings,
    "op9_lines": op9_lines,
    "op10_licenses": op10_licenses,
    "op11_manifest": op11_manifest,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": sql.DECONTAMINATE,
    "op9_lines": sql.LINES,
    "op11_manifest": sql.MANIFEST,
    "op12_exact_dedup": sql.EXACT,
    "op13_prefix_trie": sql.TRIE,
}
