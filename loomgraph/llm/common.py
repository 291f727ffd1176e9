"""What the corpus operators share: tables, shared scratch space, ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows a bucket of a distributed rank aims at, and the most buckets there are.
BUCKET_ROWS = 256
MAX_BUCKETS = 1 << 20
#: Narrow rows a broadcast table holds at most, and rows of one key beyond which it is set apart in a shuffled join.
MOST_BROADCAST, HEAVY = 500_000, 1_000_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often use reads it."""
    return F.transform(F.array(value), use)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names; one of our own only where none is set and all work is done on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that its lineage ends there.

    The files outlive any executor; drop_settled() deletes them, and what is
    left goes when the driver's JVM exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def drop_settled(*tables: DataFrame) -> None:
    """Delete settled tables that no plan reads any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_settled_at", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def is_small(df: DataFrame, most_rows: int | None = None) -> bool:
    """Whether df is counted to hold so few narrow rows that it can be broadcast."""
    most_rows = MOST_BROADCAST if most_rows is None else most_rows
    return df.limit(most_rows + 1).count() <= most_rows


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to hold few narrow rows."""
    return F.broadcast(df) if is_small(df) else df


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which holds each key once or a few times and has narrow rows, so that no key's rows meet in one task.

    A right side counted to be small is broadcast. Otherwise the keys with more
    than HEAVY rows on the left, which are few by definition, are set apart:
    their rows meet a broadcast, where it is counted to be small, and all others
    are shuffled. how: inner or left. A null key meets nothing: its rows are
    dropped by an inner join, and stay with nulls in a left one.
    """
    if is_small(right):
        return left.join(F.broadcast(right), keys, how)
    heavy = settle(left.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > HEAVY).select(*keys))
    if heavy.isEmpty():
        return left.join(right, keys, how)
    if not is_small(heavy):
        raise RuntimeError(f"more than {MOST_BROADCAST} keys hold over {HEAVY} rows each")
    rest = left.join(F.broadcast(heavy), keys, "left_anti").join(right, keys, how)  # null keys are with these
    own = small(right.join(F.broadcast(heavy), keys, "left_semi"))
    return rest.unionByName(left.join(F.broadcast(heavy), keys, "left_semi").join(own, keys, how))


def shuffle_key(seed: int, ident: Column) -> Column:
    """A seeded pseudo-random order key: md5 hex of 'seed:id' (null id: empty)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))


def bucket_count(rows: int) -> int:
    return max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))


def key_bucket(key: Column, buckets: int) -> Column:
    """The bucket of a hex key; buckets follow the order of the keys."""
    return F.expr("0L") + F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(buckets).cast("long"), 32)


def with_bucket(df: DataFrame, group: str | None, bucket: Column, weight: Column | None = None) -> DataFrame:
    """df with the columns ranked() works on; null is a group of its own."""
    weight = F.lit(0).cast("long") if weight is None else weight
    df = df.withColumns({"__g": F.col(group) if group else F.lit(0), "__b": bucket, "__w": weight})
    return df.withColumns({"__gn": F.col("__g").isNull(), "__gk": F.coalesce(F.col("__g").cast("string"), F.lit(""))}).drop("__g")


def offsets_of(bucketed: DataFrame) -> DataFrame:
    """Rows and weight before each (group, bucket), and those of the group."""
    of_group = Window.partitionBy("__gn", "__gk")
    before = of_group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.groupBy("__gn", "__gk", "__b").agg(F.count("*").alias("__n"), F.sum("__w").alias("__s"))
        .select(
            "__gn", "__gk", "__b",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"),
            F.sum("__n").over(of_group).alias("__group_rows"), F.sum("__s").over(of_group).alias("__group_weight"),
        )
    )


def ranked(df: DataFrame, group: str | None, bucket: Column, order: list[Column], weight: Column | None = None, offsets: DataFrame | None = None) -> DataFrame:
    """Exact ranks and prefix sums without putting a whole group into one task.

    bucket must not fall as rows advance in `order`. Counts by (group, bucket)
    are summed into offsets (or were, from a narrower table of the same rows),
    then rows are ranked inside their bucket only. Adds __rank (from 1),
    __before (weight of the rows before) and __group_rows, __group_weight. Null
    is a group of its own.
    """
    df = with_bucket(df, group, bucket, weight)
    offsets = offsets_of(df) if offsets is None else offsets
    inside = Window.partitionBy("__gn", "__gk", "__b").orderBy(*order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.join(offsets, ["__gn", "__gk", "__b"])
        .withColumns({"__rank": F.col("__n0") + F.row_number().over(inside), "__before": F.col("__s0") + F.sum("__w").over(up_to) - F.col("__w")})
        .drop("__gn", "__gk", "__b", "__w", "__n0", "__s0")
    )


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, label) for every node of edges(a, b); label: the least node it can be reached from.

    Least labels go to the neighbours, then every node takes its label's label,
    so the distance covered doubles each round. Every round is a written table,
    of which the last two are kept. The neighbours of a hub and the nodes of a
    giant component are spread over tasks (join_unique). Loops give a node of
    its own; an edge with a null end must not come; without edges no row.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settle(both)
    labels = settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    for _ in range(most_rounds):
        near = join_unique(both, labels.select(F.col("node").alias("b"), "label"), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = settle(labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next")))
        of = spread.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = settle(join_unique(spread, of, ["next"], "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("further", "next")).alias("label")))
        done = moved.filter("label <> old").isEmpty()
        drop_settled(spread, labels)
        labels = moved.select("node", "label")
        labels._settled_at = moved._settled_at
        if done:
            drop_settled(both)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
