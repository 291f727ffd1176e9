"""Readers and writers of graph files."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph
from ..operators.sequence import block_of, quantiles
from .numbers import file_size, numbers, read_bytes

HEADERS = {"AdjacencyGraph": False, "WeightedAdjacencyGraph": True}
#: Places of a list that are made at once, and lines of a written file.
STRETCH, FILE_LINES = 1 << 16, 10_000_000
#: Edges of a range of destinations that a writer aims at.
RANKED = 1_000_000


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(i, token): the tokens of a text file in order, split at blanks and NULs.

    The file is read in splits; tokens are counted by split and numbered
    inside, so a large file is never in one task. A folder is read as its files
    one after the other, by name.
    """
    split = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", split.alias("at"), F.monotonically_increasing_id().alias("line"))
    words = lines.select("at", "line", F.posexplode(F.filter(F.split("value", r"[\s\x00]+"), lambda x: x != "")).alias("pos", "token"))
    starts = words.groupBy("at").agg(F.count("*").alias("n")).select("at", F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = Window.partitionBy("at").orderBy("line", "pos")
    return words.join(starts, "at").select((F.col("first") + F.row_number().over(inside) - 1).alias("i"), "token")


def _from_offsets(spark: SparkSession, n: int, m: int, starts: DataFrame, targets: DataFrame, weights: DataFrame | None, symmetric: bool) -> Graph:
    """starts(v, o), targets(eid, dst), weights(eid, w): a vertex's list ends where the next one's begins.

    Places in a list are made in stretches, so a hub's are never one array.
    """
    following = starts.select((F.col("v") - 1).alias("v"), F.col("o").alias("end"))
    lists = starts.join(following, "v", "left").select("v", "o", F.coalesce("end", F.lit(m)).alias("end")).filter("o < end")
    stretches = lists.select("v", "end", F.explode(F.sequence("o", F.col("end") - 1, F.lit(STRETCH).cast("long"))).alias("o"))
    edges = stretches.select(F.col("v").alias("src"), F.explode(F.sequence("o", F.least(F.col("o") + STRETCH, "end") - 1)).alias("eid")).join(targets, "eid")
    edges = edges.join(weights, "eid") if weights is not None else edges.withColumn("w", F.lit(1).cast("long"))
    return Graph(spark.range(n), edges.select("src", "dst", "w", "eid"), symmetric)


def read_adjacency_text(spark: SparkSession, path: str, symmetric: bool = False, weighted: bool | None = None) -> Graph:
    """AdjacencyGraph or WeightedAdjacencyGraph: header, n, m, n offsets, m targets and, if weighted, m weights."""
    words = tokens(spark, path).persist()  # until the graph is given up
    head = [r[0] for r in words.filter("i < 3").orderBy("i").select("token").collect()]
    if len(head) < 3 or head[0] not in HEADERS or (weighted is not None and HEADERS[head[0]] != weighted):
        raise ValueError(f"{path}: bad header {head[:1]}")
    n, m, has_weights = int(head[1]), int(head[2]), HEADERS[head[0]]
    count, wanted = words.count(), 3 + n + m * (1 + has_weights)
    if count != wanted:
        raise ValueError(f"{path}: {count} tokens, not {wanted}")
    part = lambda first, size, key, value: words.filter((F.col("i") >= first) & (F.col("i") < first + size)).select((F.col("i") - first).alias(key), F.col("token").cast("long").alias(value))
    graph = _from_offsets(spark, n, m, part(3, n, "v", "o"), part(3 + n, m, "eid", "dst"), part(3 + n + m, m, "eid", "w") if has_weights else None, symmetric)
    return replace(graph, owned=(words,))


def with_transpose_checked(graph: Graph, transposed: Graph) -> Graph:
    """graph, if the companion holds the same edges turned round; an error otherwise."""
    own, other = graph.edges.select("src", "dst", "w"), transposed.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    if graph.n != transposed.n or not own.exceptAll(other).isEmpty() or not other.exceptAll(own).isEmpty():
        raise ValueError("the companion file is not the transpose")
    return graph


def _part(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.select(F.col("at").alias(key), F.col("value").alias(value))


def read_gr(spark: SparkSession, path: str, symmetric: bool = False, wide: bool = True) -> Graph:
    """Binary version 1: version, edge size (4: weighted), n, m; n end offsets; m 32-bit targets, padded to an even number; m weights.

    wide: header and offsets have 64 bits, else 32. The driver reads the header;
    offsets, targets and weights are read by ranges of bytes, so a file may have any size.
    """
    size = np.dtype(np.int64 if wide else np.int32)
    head = np.frombuffer(read_bytes(path, 0, 4 * size.itemsize), size)
    if len(head) < 4 or head[0] != 1:
        raise ValueError(f"{path}: version {head[:1]}")
    weighted, n, m = head[1] == 4, int(head[2]), int(head[3])
    targets_at = (4 + n) * size.itemsize
    weights_at = targets_at + 4 * (m + m % 2)
    wanted = weights_at + 4 * m if weighted else targets_at + 4 * m
    if file_size(path) < wanted:
        raise ValueError(f"{path}: {file_size(path)} bytes, not {wanted}")
    ends = numbers(spark, path, size.str, n, 4 * size.itemsize)
    starts = ends.select((F.col("at") + 1).alias("v"), F.col("value").alias("o")).filter(F.col("v") < n)
    first = spark.range(1 if n else 0).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("o"))
    weights = _part(numbers(spark, path, "<i4", m, weights_at), "eid", "w") if weighted else None
    return _from_offsets(spark, n, m, first.unionByName(starts), _part(numbers(spark, path, "<u4", m, targets_at), "eid", "dst"), weights, symmetric)


def read_csr(spark: SparkSession, stem: str, symmetric: bool = False, wide: bool = True) -> Graph:
    """stem.config (text: n), stem.adj (32-bit targets), stem.idx (start offsets); weights are 1. Both binaries are read by ranges of bytes."""
    n = int(spark.read.text(f"{stem}.config").first()[0].split()[0])
    m = file_size(f"{stem}.adj") // 4
    offsets = numbers(spark, f"{stem}.idx", "<i8" if wide else "<i4", n)
    return _from_offsets(spark, n, m, _part(offsets, "v", "o"), _part(numbers(spark, f"{stem}.adj", "<u4", m), "eid", "dst"), None, symmetric)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_graph(spark: SparkSession, path: str, fmt: str = "text", symmetric: bool = False) -> Graph:
    """fmt: text, gr or csr. Where a directed graph in text or gr has a companion beside it, path_t, both must have the same size.

    The in-edges are those of the file itself, turned round; with_transpose_checked
    holds the companion's edges against them.
    """
    read = {"text": read_adjacency_text, "gr": read_gr, "csr": read_csr}[fmt]
    graph = read(spark, path, symmetric=symmetric)
    if fmt != "csr" and not symmetric and _exists(spark, f"{path}_t"):
        other = read(spark, f"{path}_t")
        if (graph.n, graph.m) != (other.n, other.m):
            raise ValueError(f"{path}_t: {other.n} vertices and {other.m} edges, not {graph.n} and {graph.m}")
    return graph


def csr_offsets(graph: Graph) -> DataFrame:
    """(id, offset): where each vertex's list begins when edges are laid out by source."""
    from ..operators.sequence import plus_scan

    return plus_scan(graph.degrees().select("id", F.col("out_degree").alias("degree")), "id", "degree", "offset").select("id", "offset")


def write_adjacency_text(graph: Graph, path: str, weighted: bool = False) -> None:
    """A folder of text files that follow each other by name; ids must run from 0 to n - 1.

    An edge's place is its source's offset, the edges of its source in lower
    ranges of destinations, and its rank among those of its own range, so that
    a hub's edges are ranked by several tasks; lines are ranged and written by
    many. Parallel edges are of one range.
    """
    offsets = csr_offsets(graph)
    ranges = -(-graph.m // RANKED)
    edges = graph.edges.select("src", "dst", "w", block_of(F.col("dst"), quantiles(graph.edges, "dst", ranges)).alias("range"))
    lower = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = edges.groupBy("src", "range").agg(F.count("*").alias("n")).select("src", "range", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before"))
    number = Window.partitionBy("src", "range").orderBy("dst", "w")
    edges = edges.withColumn("rank", F.row_number().over(number) - 1).join(before, ["src", "range"])
    edges = edges.join(offsets.withColumnRenamed("id", "src"), "src").select("dst", "w", (F.col("offset") + F.col("before") + F.col("rank")).alias("at"))
    head = graph.vertices.sparkSession.createDataFrame([(0, 0, "WeightedAdjacencyGraph" if weighted else "AdjacencyGraph"), (0, 1, str(graph.n)), (0, 2, str(graph.m))], "part int, at long, line string")
    out = head.unionByName(offsets.select(F.lit(1).alias("part"), F.col("id").alias("at"), F.col("offset").cast("string").alias("line")))
    out = out.unionByName(edges.select(F.lit(2).alias("part"), "at", F.col("dst").cast("string").alias("line")))
    if weighted:
        out = out.unionByName(edges.select(F.lit(3).alias("part"), "at", F.col("w").cast("string").alias("line")))
    files = -(-(3 + graph.n + (1 + weighted) * graph.m) // FILE_LINES)
    out.repartitionByRange(files, "part", "at").sortWithinPartitions("part", "at").select("line").write.mode("overwrite").text(path)
