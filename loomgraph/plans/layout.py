"""Edges laid out once for all rounds of a program, so that a round moves messages and nothing else.

A state counted to be small is broadcast to the edges where they are. Beyond
that, edges lie with the state of one end, by hash and in order of it, and where
they have nothing but their ends as one list for each vertex, so that a round
joins vertices and not edges; hubs, whose edges would all meet in one task, are
cut: their edges are dealt out over all tasks by the other end, and only their
states, which are few, are replicated there. Vertices with many edges, of which
there are no more than what may be broadcast, are hubs too: what they send is
folded where it arrives, so that it is one partial sum for each destination.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import edge_map
from .loop import delete, new_path, written

#: A vertex is a hub if it has more than this share of a partition's edges; so there are at most so many of these for each partition.
HUB_SHARE = 16
#: Edges that a task of a round reads at least, where tasks are more than cores.
TASK_EDGES = 1_000_000
#: Least edges of a vertex that is a hub since there are few such; it is a power of two.
LEAST_HUB = 64
#: Edges of a large layout that a task folds the messages of: the more, the fewer partial sums.
FOLDED_EDGES = 2_000_000
#: Edges of a range of an index, and ranges at most.
RANGE_EDGES, MOST_RANGES = 200_000, 4096


class Index:
    """Edges written by ranges of their source, sorted inside; the out-edges of a few vertices are read from their ranges alone.

    Ranges are cut by (src, dst), so that a hub's edges lie in several. The
    driver holds the bounds of MOST_RANGES ranges at most; a broadcast frontier
    that names its ranges prunes the others when the scan starts.
    """

    def __init__(self, edges: DataFrame, ranges: int | None = None):
        self.spark, m = edges.sparkSession, edges.count()
        ranges = ranges or max(1, min(MOST_RANGES, m // RANGE_EDGES))
        self.path = new_path(self.spark)
        laid = edges.repartitionByRange(ranges, "src", "dst").sortWithinPartitions("src", "dst").withColumn("range", F.spark_partition_id())
        laid.write.partitionBy("range").parquet(self.path)
        self.edges = self.spark.read.parquet(self.path) if m else edges.limit(0).withColumn("range", F.lit(0))
        bounds = self.edges.groupBy("range").agg(F.min("src").alias("low"), F.max("src").alias("high")).collect()
        self.bounds = F.array(*[F.struct(F.lit(b.range).alias("range"), F.lit(b.low).alias("low"), F.lit(b.high).alias("high")) for b in sorted(bounds)]) if bounds else None

    def meet(self, state: DataFrame) -> DataFrame:
        """Edges joined with a small state(src, ...) that a filter has made."""
        if self.bounds is None:
            return self.edges.join(state, "src").drop("range")
        inside = F.transform(F.filter(self.bounds, lambda b: (b["low"] <= F.col("src")) & (F.col("src") <= b["high"])), lambda b: b["range"])
        return self.edges.join(F.broadcast(state.withColumn("range", F.explode(inside))), ["range", "src"]).drop("range")

    def free(self) -> None:
        delete(self.spark, self.path)


def indexed(graph: Graph, ranges: int | None = None) -> Graph:
    """graph with an index of its out-edges, which the programs read where a frontier has few of them; free it with unpersist()."""
    return replace(graph, index=Index(graph.edges, ranges))


class Layout:
    """The edges of a graph of n vertices as joined with the state of one end, on ('src' or 'dst'), round after round."""

    def __init__(self, edges: DataFrame, n: int, on: str = "src", index: Index | None = None, held: bool = False, degrees: DataFrame | None = None, own: bool = False):
        """held: the edges are in memory already; degrees(on, __n): the edges of each vertex, where they are known; own: messages are folded by the end the edges lie with."""
        self.on, self.n, self.small, self.index = on, n, n <= edge_map.MOST_PUSHED, index
        self.parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.columns, self.tasks = edges.columns, self.parts
        self.hubs = self.dealt = self.listed = None
        if self.small:
            self.plain = edges if held else edges.persist()
            return
        self.hubs, self.path, cut, m = self._cut(edges, degrees, own)
        if cut:
            # In order of the other end, a task's messages go to few vertices; ranges share out one that many hubs send to.
            dealt, other = edges.join(F.broadcast(self.hubs), on, "left_semi"), "dst" if on == "src" else "src"
            self.dealt = (dealt.repartition(self.parts) if own else dealt.repartitionByRange(self.parts, other, on).sortWithinPartitions(other)).persist()
            edges = edges.join(F.broadcast(self.hubs), on, "left_anti")
        others = [c for c in edges.columns if c != on]
        laid = edges.filter(F.col(on).isNotNull()).repartition(self.parts, on)
        if len(others) == 1:  # null ends, which collect_list drops, meet no vertex
            self.listed = others[0]
            laid = laid.groupBy(on).agg(F.collect_list(self.listed).alias("__list"))
        # What is held in order needn't be sorted again for the join of each round.
        self.plain = laid.sortWithinPartitions(on).persist()
        if not own:
            self.tasks = max(edges.sparkSession.sparkContext.defaultParallelism, (m - cut) // FOLDED_EDGES)

    def _cut(self, edges: DataFrame, known: DataFrame | None, own: bool) -> tuple[DataFrame, str, int, int]:
        """(the hubs, the path they are written to, their edges, all edges)."""
        degrees = known if known is not None else edges.groupBy(self.on).agg(F.count("*").alias("__n")).persist()
        meeting = degrees.filter((F.col("__n") > 0) & F.col(self.on).isNotNull())
        steps = meeting.groupBy(F.floor(F.log2("__n")).alias("step")).agg(F.count("*").alias("n"), F.sum("__n").alias("m")).collect()
        m = sum(r.m for r in steps)
        least = max(1, m // (HUB_SHARE * self.parts)) + 1
        for step in range(LEAST_HUB.bit_length() - 1, 0 if own else least.bit_length()):
            if sum(r.n for r in steps if r.step >= step) <= edge_map.MOST_PUSHED:
                least = min(least, 1 << step)
                break
        hubs, (cut,), path = written(meeting.filter(F.col("__n") >= least).select(self.on, "__n"), F.coalesce(F.sum("__n"), F.lit(0)))
        if known is None:
            degrees.unpersist()
        return hubs.select(self.on), path, cut, m

    @classmethod
    def of(cls, graph: Graph, *columns: str, on: str = "src", own: bool = False) -> Layout:
        """src, dst and other columns of the edges of a graph; with its index, and without a copy of edges that are held."""
        edges, held = graph.edges.select("src", "dst", *columns), graph.edges.storageLevel.useMemory
        if held and graph.n <= edge_map.MOST_PUSHED:  # tables in memory keep the partitions they were made with
            edges = edges.coalesce(max(edges.sparkSession.sparkContext.defaultParallelism, graph.m // TASK_EDGES))
        degrees = graph.held_degrees.select(F.col("id").alias(on), F.col("out_degree" if on == "src" else "in_degree").alias("__n")) if held else None
        return cls(edges, graph.n, on, graph.index if on == "src" else None, held, degrees, own)

    def meet(self, state: DataFrame, rows: int | None = None, sparse: bool = False) -> DataFrame:
        """Edges joined with state(on, ...) of `rows` vertices (n, where not counted). sparse: they are known to have few edges."""
        rows = self.n if rows is None else rows
        if sparse and self.index is not None and rows <= edge_map.MOST_PUSHED:
            return self.index.meet(state).select(*[c for c in [*self.columns, *state.columns[1:]] if c != self.on], self.on)
        few = rows <= edge_map.MOST_PUSHED
        out = self.plain.join(F.broadcast(state) if few else state, self.on)
        if self.listed is not None:
            out = out.select(self.on, F.explode("__list").alias(self.listed), *[c for c in state.columns if c != self.on])
        if self.tasks < self.parts:
            out = out.coalesce(self.tasks)
        if self.dealt is not None:
            mirrors = F.broadcast(state if few else state.join(F.broadcast(self.hubs), self.on, "left_semi"))
            out = out.unionByName(self.dealt.join(mirrors, self.on))
        return out

    def merged(self, state: DataFrame, sent: DataFrame, **folds: Column) -> DataFrame:
        """state(id, ...) with the folds of sent(id, ...) for each vertex, null where nothing was sent.

        Folds must pass over nulls; columns of state and of sent have names of
        their own. A small state is merged with what is sent by one aggregation;
        a large one stays where it lies and is joined with the folds, of which
        partial ones are made before they move.
        """
        if not self.small:
            got = sent.groupBy("id").agg(*[v.alias(k) for k, v in folds.items()])
            return self.placed(state).join(got, "id", "left")
        kept, more = [c for c in state.columns if c != "id"], [c for c in sent.columns if c != "id"]
        kinds = dict(sent.dtypes) | dict(state.dtypes)
        none = lambda cs: [F.lit(None).cast(kinds[c]).alias(c) for c in cs]
        both = state.select("id", *kept, *none(more)).unionByName(sent.select("id", *none(kept), *more))
        merged = both.groupBy("id").agg(*[F.max(c).alias(c) for c in kept], *[v.alias(k) for k, v in folds.items()])
        few = state.sparkSession.sparkContext.defaultParallelism  # held states aren't coalesced by the planner
        return merged.coalesce(few) if few < self.parts else merged

    def placed(self, state: DataFrame) -> DataFrame:
        """state laid out by id, as what the rounds make of it is; the planner leaves a layout that is right alone."""
        return state if self.small else state.repartition(self.parts, "id")

    def free(self) -> None:
        self.plain.unpersist()
        if self.dealt is not None:
            self.dealt.unpersist()
        if self.hubs is not None:
            delete(self.plain.sparkSession, self.path)
