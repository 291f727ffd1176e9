"""The queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import clusters
from .common import table
from .decontam import decontaminate
from .embedding import near_vectors
from .line_dedup import dedup_lines
from .mix import plan_mix
from .ngram_join import similar_documents
from .oracle import ORACLE
from .pii import KINDS, count, find_pii, listed
from .quality import judge_quality
from .secrets import find_secrets
from .shard import shard_interleaved
from .substring import repeated_units
from .toxicity import score_toxicity
from .whiten import whiten

N_SHARDS = 24


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [count("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law: rows. Text is reduced to its size and checksum before any row moves."""
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    placed = shard_interleaved(docs.select("doc_id", "text", "source", size.alias("size"), crc.alias("text_crc32")), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def mixing_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words the mix takes of each document, which follow from the quotas of blocks: the part of op6_mixing that SQL can express."""
    taken = F.col("size") * F.size("draws")
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the draws that make up taken, as epoch:shard:order. The tree's draws come from numpy, so SQL has no counterpart."""
    listed = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["epoch"].cast("string"), d["shard"].cast("string"), d["order"].cast("string"))), ",")
    taken = F.col("size") * F.size("draws")
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken.alias("taken"), listed.alias("draws"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line or sentence that is removed, so a document without repeats has none."""
    return repeated_units(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept", F.round("recall", 3).alias("audited_recall"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact deviation must fit into a long here; that of the operator is a decimal."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "mixing_quotas": mixing_quotas,
    "op7_secrets": op7_secrets,
    "op8_substrings": op8_substrings,
    "op9_decontamination": op9_decontamination,
    "op10_embeddings": op10_embeddings,
    "op11_clustering": op11_clustering,
    "op12_whitening": op12_whitening,
    "op13_line_dedup": op13_line_dedup,
}


__all__ = ["ORACLE", "QUERIES"]
