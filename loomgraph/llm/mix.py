"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_count, drop_settled, key_bucket, offsets_of, ranked, settle, shuffle_key, small, with_bucket

#: Blocks a source is cut into, documents never being cut; fewer where sources are so many that a tree would hold more blocks than an exact draw takes.
BLOCKS, MOST_BLOCKS = 4096, 900_000_000
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def words(text: str = "text"):
    """Number of runs of characters other than blanks; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_EPOCHS) -> DataFrame:
    """sources(source, source_size) with weight, place and target.

    Sources take the weights in turn by code point, null last. Targets share
    the sum of all sizes by weight; one never exceeds cap times its source, and
    what is cut off is shared again. Taken by rising cap per weight, a source is
    full iff its share of what is left reaches its cap. One task sorts the
    sources; it holds one row for each.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("place", F.row_number().over(place) - 1).withColumn("weight", turn.cast("double")).withColumn("__cap", (cap * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("weight"), "place")
    all_rows = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__all": F.sum("source_size").over(all_rows).cast("double"), "__gone": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)), "__left": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))})
    rows = rows.withColumn("__full", F.col("__cap") * F.col("__left") <= F.col("weight") * (F.col("__all") - F.col("__gone")))
    rows = rows.withColumns({"__gone": F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(all_rows), F.lit(0.0)), "__left": F.sum(F.when(~F.col("__full"), F.col("weight"))).over(all_rows)})
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("weight") * (F.col("__all") - F.col("__gone")) / F.col("__left"))
    return rows.select("source", "source_size", "place", "weight", F.round(target, 6).alias("target"))


def split_tree(n_shards: int, seed: int):
    """For mapInPandas over rows (place, quota, total) in order of place, in one task.

    Each node of a binary tree over the shards hands part of its blocks to its
    left child; how many of each source is one multivariate-hypergeometric draw,
    made source by source. Memory holds two numbers a node, whatever the number
    of sources. Adds cuts: for each shard, the blocks of the source in the
    shards up to and with it. Draws are exact: there are fewer than 10**9 blocks.
    """

    def draw(rng, good: int, bad: int, need: int) -> int:
        if need == 0 or good == 0:
            return 0
        if bad == 0:
            return need
        return int(rng.hypergeometric(good, bad, need))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: dict[tuple[int, int], list[int]] = {}

        def go(lo: int, hi: int, quota: int, place: int, out: list[int]) -> None:
            if hi - lo == 1:
                out[lo] = quota
                return
            mid, node = (lo + hi) // 2, left[lo, hi]
            rng = np.random.default_rng([seed, place, lo, hi])
            took = draw(rng, quota, node[0] - quota, node[1])
            node[0] -= quota
            node[1] -= took
            go(lo, mid, took, place, out)
            go(mid, hi, quota - took, place, out)

        def plan(lo: int, hi: int, total: int) -> None:
            if hi - lo > 1:
                mid = (lo + hi) // 2
                first = total * (mid - lo) // (hi - lo)
                left[lo, hi] = [total, first]
                plan(lo, mid, first)
                plan(mid, hi, total - first)

        for pdf in batches:
            cuts = []
            for place, quota, total in zip(pdf.place, pdf.quota, pdf.total):
                if not left:
                    plan(0, n_shards, int(total))
                out = [0] * n_shards
                go(0, n_shards, int(quota), int(place), out)
                cuts.append(np.cumsum(out).tolist())
            yield pd.DataFrame({"place": pdf.place, "cuts": cuts})

    return run


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with __size, and the seeded order of the rows of a source."""
    crc = F.coalesce(F.crc32(F.col("text")), F.lit(-1).cast("long"))
    return docs.withColumns({"__size": words(), "__key": shuffle_key(seed, F.col("doc_id")), "__crc": crc})


class _Plan:
    """Quotas and the tree's dealing, made of sizes and keys alone; apply() lays them over the same rows."""

    def __init__(self, keyed: DataFrame, n_shards: int, seed: int, weights: tuple[int, ...]):
        self.seed, self.bucket = seed, key_bucket(F.col("__key"), bucket_count(keyed.count()))
        self.offsets = settle(offsets_of(with_bucket(keyed, "source", self.bucket, F.col("__size"))))
        sources = settle(keyed.groupBy("source").agg(F.sum("__size").alias("source_size")))
        self.blocks = max(1, min(BLOCKS, MOST_BLOCKS // (MOST_EPOCHS * max(1, sources.count()))))
        aims = settle(targets(sources, weights))
        blocks = self._placed(keyed).groupBy("source", F.col("__source_size").alias("source_size"), "__block").agg(F.sum("__size").alias("__words"))
        in_source = Window.partitionBy("place").orderBy("__block")
        aimed = blocks.join(small(aims.drop("source_size").withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        so_far = F.sum("__words").over(in_source.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__words")
        full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS))).otherwise(F.lit(0)).cast("long")
        aimed = aimed.withColumn("__full", full).withColumns({"__seq": F.row_number().over(in_source) - 1, "__extra": (so_far + F.col("__words") / 2 <= F.col("target") - F.col("__full") * F.col("source_size")) & (F.col("__full") < MOST_EPOCHS)})
        aimed = settle(aimed.withColumn("__times", F.col("__full") + F.col("__extra").cast("long")))

        quotas = aimed.groupBy("place").agg(F.sum("__times").alias("quota"), F.count("*").alias("n_blocks"))
        total = quotas.agg(F.sum("quota")).first()[0] or 0
        cuts = quotas.select("place", "quota", F.lit(int(total)).cast("long").alias("total")).coalesce(1).sortWithinPartitions("place").mapInPandas(split_tree(n_shards, seed), "place int, cuts array<long>")
        cuts = small(settle(cuts.join(quotas.select("place", "n_blocks"), "place")))
        # A block's draw of an epoch is a place in the source's sequence; its shard is the first whose cut lies beyond it.
        dealt = aimed.join(cuts, "place").withColumn("dealt", F.expr("if(__times = 0, cast(array() as array<struct<epoch:int,shard:int>>), transform(sequence(0L, greatest(__times, 1L) - 1), e -> struct(cast(e as int) as epoch, cast(size(filter(cuts, x -> x <= e * n_blocks + __seq)) as int) as shard)))"))
        self.dealt = settle(dealt.select(F.col("source").alias("__s"), F.col("__block").alias("__at"), F.col("target").alias("__target"), F.col("dealt").alias("__dealt")))
        drop_settled(sources, aims, aimed)

    def _placed(self, rows: DataFrame) -> DataFrame:
        order = [F.col("__key"), F.col("doc_id"), F.col("__crc")]
        block = F.expr(f"if(__source_size > 0, least(__before * {self.blocks}L div __source_size, {self.blocks - 1}L), 0L)")
        return ranked(rows, "source", self.bucket, order, F.col("__size"), self.offsets).withColumnRenamed("__group_weight", "__source_size").withColumn("__block", block)

    def apply(self, keyed: DataFrame) -> DataFrame:
        """keyed with __source_size, __target and __draws; every draw has its epoch, shard and place in the shard's local shuffle."""
        out = self._placed(keyed)
        out = out.join(small(self.dealt), out.source.eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__at")))
        draws = F.transform("__dealt", lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.xxhash64(F.lit(self.seed), d["shard"], d["epoch"], F.col("doc_id"), F.col("__crc")).alias("order")))
        return out.withColumn("__draws", draws).drop("__at", "__block", "__s", "__rank", "__before", "__group_rows", "__key", "__crc", "__dealt")


_TOLD = ("size", "source_size", "target")


def plan_mix(docs: DataFrame, n_shards: int = 16, seed: int = 23, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, draws), one for each row of docs.

    Documents are put in seeded order within their source and cut into blocks
    of nearly equal words. A source gives whole epochs of all its blocks and,
    from the next epoch, the leading blocks whose middle lies within what is
    left of its target: it misses the target by half a block at most. The
    splitting tree deals the exact number of blocks of each source out to the
    shards; a shard draws the next blocks of the source's permuted sequence, so
    draws are disjoint. draws is an array of (epoch, shard, order), empty for a
    document the mix leaves out; order shuffles the rows of a shard.

    Texts are read once, for their sizes. Null texts and empty texts have size 0
    and are carried along with their block; null is a source of its own; rows
    with equal ids are ordered by the checksum of the text, and rows equal in
    both are interchangeable. Other columns are ignored; an empty table gives
    no row.
    """
    keyed = settle(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"))
    return _Plan(keyed, n_shards, seed, weights).apply(keyed).select("doc_id", "source", *[F.col(f"__{c}").alias(c) for c in (*_TOLD, "draws")])


def mix(docs: DataFrame, n_shards: int = 16, seed: int = 23, weights: tuple[int, ...] = WEIGHTS, told: bool = True) -> DataFrame:
    """The mixture: a row of docs for each of its draws, with size, source_size, target, mix_shard, mix_epoch and mix_order.

    Rows are dealt out by shard and by a stretch of mix_order, of which a shard
    has 256, and sorted by both within a partition: the
    shard's local shuffle wants them. Nulls, ties and empty tables are treated
    as in plan_mix; columns of those names are replaced, names that begin with
    two underscores reserved and dropped. Without `told` all other columns are
    those of docs, whatever their names, and only the layout shows the shards.
    """
    columns = [c for c in docs.columns if not c.startswith("__")]
    docs = docs.select(columns)
    narrow = settle(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"))
    drawn = _Plan(narrow, n_shards, seed, weights).apply(_keyed(docs, seed)).withColumn("__d", F.explode("__draws"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = drawn.repartition(parts, F.col("__d.shard"), F.shiftright("__d.order", 56)).sortWithinPartitions("__d.shard", "__d.order")
    if not told:
        return laid.select(columns)
    own = {**{c: F.col(f"__{c}") for c in _TOLD}, **{f"mix_{c}": F.col(f"__d.{c}") for c in ("shard", "epoch", "order")}}
    return laid.select(*[c for c in columns if c not in own], *[v.alias(k) for k, v in own.items()])
