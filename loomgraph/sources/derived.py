"""Graphs derived from the star-schema tables. Even and odd ids keep the two sides apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph, from_edges


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _both_ways(pairs: DataFrame) -> Graph:
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return from_edges(pairs.select(F.explode(ends).alias("e"), "w").select("e.*", "w"), symmetric=True)


def customer_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Who ordered from whom."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (2 * F.col("o_custkey")).alias("a"))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (2 * F.col("l_suppkey") + 1).alias("b"))
    # Few pairs repeat, so none are sought before they are dealt out.
    return _both_ways(orders.join(lines, "k").select("a", "b").repartition("a", "b").distinct().withColumn("w", F.lit(1).cast("long")))


def part_supplier(spark: SparkSession, sf_dir: str, every: bool = False) -> Graph:
    """Large returned lines, or all: parts and suppliers, weighed by the least line number."""
    lines = _table(spark, sf_dir, "lineitem")
    if not every:
        lines = lines.filter((F.col("l_quantity") >= 50) & (F.col("l_returnflag") == "R"))
    return _both_ways(lines.groupBy((2 * F.col("l_partkey")).alias("a"), (2 * F.col("l_suppkey") + 1).alias("b")).agg(F.min("l_linenumber").cast("long").alias("w")))


def order_part(spark: SparkSession, sf_dir: str, every: bool = False) -> Graph:
    """Large lines, or all: orders and parts."""
    lines = _table(spark, sf_dir, "lineitem")
    if not every:
        lines = lines.filter(F.col("l_quantity") >= 50)
    return _both_ways(lines.select((2 * F.col("l_orderkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b")).distinct().withColumn("w", F.lit(1).cast("long")))


def nation_nation(spark: SparkSession, sf_dir: str) -> Graph:
    """Supplier nation to customer nation, weighed by the number of lines."""
    t = lambda name: _table(spark, sf_dir, name)
    rows = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    rows = rows.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    edges = rows.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("w"))
    return from_edges(edges, t("nation").select(F.col("n_nationkey").alias("id")))


def places(spark: SparkSession, sf_dir: str) -> Graph:
    """A tree: regions, their nations, and the nations' customers and suppliers; remainders by four keep the kinds apart."""
    ends = [("nation", "n_regionkey", 0, "n_nationkey", 1), ("customer", "c_nationkey", 1, "c_custkey", 2), ("supplier", "s_nationkey", 1, "s_suppkey", 3)]
    edges = [_table(spark, sf_dir, name).select((4 * F.col(a).cast("long") + i).alias("src"), (4 * F.col(b).cast("long") + j).alias("dst")) for name, a, i, b, j in ends]
    return from_edges(edges[0].unionByName(edges[1]).unionByName(edges[2]))


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_type, dst_type, w): how often one event type follows another with the same user.

    Events are put in order by user and hour, so that a busy user's are no
    single group; the last of an hour is followed by the first of the user's next.
    """
    events = _table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "event_type")
    after = F.lead("event_type").over(Window.partitionBy("user_id", "hour").orderBy("ts", "event_id"))
    inside = events.select(F.col("event_type").alias("src_type"), after.alias("dst_type"))
    order = F.struct("ts", "event_id")
    hours = events.groupBy("user_id", "hour").agg(F.min_by("event_type", order).alias("first"), F.max_by("event_type", order).alias("last"))
    between = hours.select(F.col("last").alias("src_type"), F.lead("first").over(Window.partitionBy("user_id").orderBy("hour")).alias("dst_type"))
    return inside.unionByName(between).filter("dst_type is not null").groupBy("src_type", "dst_type").agg(F.count("*").alias("w"))
