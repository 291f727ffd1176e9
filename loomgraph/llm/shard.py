"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, key_bucket, ranked, shuffle_key


def shard_interleaved(docs: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """Give every row a shard and a slot so that each shard mirrors the mixture of sources.

    Rows are put in seeded order within their source; the fractional rank
    (rank - 1/2) / rows of the source orders all rows, and this order is cut
    into n_shards runs whose row counts differ by one at most.

    All columns stay; shard (int) and slot (long, from 0 without gaps) are
    added and replace columns of those names; names that begin with two
    underscores are reserved. Null sources are one stratum,
    ordered last; null and empty texts count as rows like any other; rows with
    equal ids are ordered by their text's checksum, and rows equal in both are
    interchangeable. An empty input gives an empty output.
    """
    n = docs.count()
    buckets = bucket_count(n)
    own = {"__key": shuffle_key(seed, F.col("doc_id")), "__crc": F.coalesce(F.crc32(F.col("text")), F.lit(-1).cast("long"))}
    within = ranked(docs.withColumns(own), "source", key_bucket(F.col("__key"), buckets), [F.col("__key"), F.col("doc_id"), F.col("__crc")])
    within = within.withColumn("__frac", (2 * F.col("__rank") - 1) / (2 * F.col("__group_rows"))).withColumnRenamed("__rank", "__in_source").drop("__group_rows", "__group_weight")
    order = [F.col("__frac"), F.col("source").asc_nulls_last(), F.col("__in_source")]
    overall = ranked(within, None, F.floor(F.col("__frac") * buckets), order)
    at = F.col("__rank") - 1
    shard = F.expr(f"(__rank - 1) * {n_shards}L div {max(n, 1)}L")
    return (
        overall.withColumn("__shard", shard)
        .withColumn("__slot", at - F.expr(f"(__shard * {n}L + {n_shards - 1}L) div {n_shards}L"))
        .drop("shard", "slot")
        .withColumns({"shard": F.col("__shard").cast("int"), "slot": F.col("__slot")})
        .drop(*[c for c in overall.columns if c.startswith("__")], "__shard", "__slot")
    )
