"""The corpus pipeline: five stages, each on all rows its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Rows are told by their id and text together,
so nulls and ties in doc_id, repeated rows, null, empty and very long texts are
no error in any stage; an empty table stays empty, and so does the result.
Columns of documents beyond the five stay as they are, whatever their names,
but for those of the result's own columns (shard, slot) and for names that
begin with two underscores, which the mixing stage drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import settle, table
from loomgraph.llm.decontam import without_contaminated
from loomgraph.llm.mix import mix
from loomgraph.llm.ngram_join import one_of_each
from loomgraph.llm.quality import accepted
from loomgraph.llm.shard import shard_interleaved

N_SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go; without labels of both kinds all share one verdict."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id; texts without words all stay."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; without items all stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document comes as often as it is drawn, or not at all.

    Rows are laid out by the shard the tree draws them for and shuffled inside
    it. A stage but the last returns the columns of documents, so the tree's
    shard has no column here; the sharding stage deals the mixture out anew.
    """
    return mix(docs, told=False)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot."""
    return shard_interleaved(docs, N_SHARDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
