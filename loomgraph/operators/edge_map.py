"""The three higher-order operators: edge_map, vertex_map and vertex_filter; and frontiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph

#: A frontier is pushed (broadcast) while it and its out-edges are less than this share of the edges.
SPARSE_SHARE = 20
#: Rows a pushed frontier has at most, whatever the number of edges.
MOST_PUSHED = 1_000_000
#: Destinations whose states a task holds at once in a fold of the caller's own.
MOST_FOLDED = 200_000
#: Messages or states that such a fold is handed at once.
FOLD_ROWS = 200_000

#: Commutative monoids messages are combined with. Each has partial aggregation.
COMBINE: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "or": F.bit_or,
    "product": F.product,
    "quotient": lambda c: F.product(1 / c),
    "count": F.count,
    "any": F.any_value,
}


@dataclass(frozen=True)
class EdgeFn:
    """What an edge map does along an edge.

    message: Column over src, dst, w, eid and the state of the source as s_name
    (and of the destination as d_name, where cond or message needs it);
    combine: a name in COMBINE, or any aggregate of the message as a function of
    a column (structs of several folds too), of which Spark makes partial ones
    before the shuffle; cond: predicate on d_name that a destination
    must meet before messages are made; activate: predicate on value and d_name
    that puts a destination into the next frontier (default: any message does).
    """

    message: Column
    combine: str | Callable[[Column], Column] = "sum"
    cond: Column | None = None
    activate: Column | None = None
    needs_source: bool = True
    needs_destination: bool = False


def single(graph: Graph, source: int) -> DataFrame:
    """The frontier of one vertex; it must be in the graph."""
    if graph.vertices.filter(F.col("id") == source).isEmpty():
        raise ValueError(f"vertex {source} is not in the graph")
    return graph.vertices.sparkSession.range(source, source + 1, 1, 1)


def everything(graph: Graph) -> DataFrame:
    return graph.vertices.select("id")


def nothing(graph: Graph) -> DataFrame:
    return graph.vertices.select("id").limit(0)


def where(state: DataFrame, predicate: Column) -> DataFrame:
    return state.filter(predicate).select("id")


def frontier_stats(graph: Graph, frontier: DataFrame) -> DataFrame:
    """One row: size of the frontier and the sum of its out-degrees, which the graph holds once they were asked for."""
    return frontier.join(graph.held_degrees, "id", "left").agg(F.count("*").alias("size"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("out_edges"))


def is_sparse(graph: Graph, size: int, out_edges: int) -> bool:
    return size <= MOST_PUSHED and size + out_edges <= graph.m // SPARSE_SHARE


def active_edges(graph: Graph, frontier: DataFrame | None, pushed: bool = False) -> DataFrame:
    """The out-edges of a frontier; all edges for None. pushed: broadcast it, its size having been checked.

    Where the graph has an index, a pushed frontier reads its own ranges of edges alone.
    """
    if frontier is None:
        return graph.edges
    ids = frontier.select(F.col("id").alias("src"))
    if pushed and graph.index is not None:
        return graph.index.meet(ids.distinct()).select("src", "dst", "w", "eid")
    return graph.edges.join(F.broadcast(ids) if pushed else ids, "src", "left_semi").select("src", "dst", "w", "eid")


def edge_map(graph: Graph, state: DataFrame, fn: EdgeFn, frontier: DataFrame | None = None, pushed: bool = False) -> DataFrame:
    """Rows (id, value, active) of the destinations that got a message.

    frontier joined with edges, the destination's predicate, a combining
    aggregate by destination. Filters come before the aggregate, and columns no
    message reads are pruned by the planner.
    """
    edges = active_edges(graph, frontier, pushed)
    if fn.needs_source:
        edges = edges.join(state.select(*[F.col(c).alias("src" if c == "id" else f"s_{c}") for c in state.columns]), "src")
    reads_destination = fn.cond is not None or fn.needs_destination
    to = state.select(*[F.col(c).alias("dst" if c == "id" else f"d_{c}") for c in state.columns])
    if reads_destination:
        edges = edges.join(to, "dst")
    if fn.cond is not None:
        edges = edges.filter(fn.cond)
    fold = fn.combine if callable(fn.combine) else COMBINE[fn.combine]
    out = edges.select("dst", fn.message.alias("message")).groupBy("dst").agg(fold(F.col("message")).alias("value"))
    if fn.activate is None:
        return out.select(F.col("dst").alias("id"), "value", F.lit(True).alias("active"))
    return out.join(to, "dst").select(F.col("dst").alias("id"), "value", fn.activate.alias("active"))


@dataclass(frozen=True)
class EdgeMapStats:
    """What an edge map was chosen by: the frontier's vertices and their out-edges, and whether it was pushed."""

    size: int
    out_edges: int
    pushed: bool


def edge_map_counted(graph: Graph, state: DataFrame, fn: EdgeFn, frontier: DataFrame) -> tuple[DataFrame, EdgeMapStats]:
    """edge_map over a frontier that is counted first: it is pushed if it and its out-edges are few, else all edges are read."""
    size, out_edges = frontier_stats(graph, frontier).first()
    pushed = is_sparse(graph, size, out_edges)
    return edge_map(graph, state, fn, frontier, pushed), EdgeMapStats(size, out_edges, pushed)


@dataclass(frozen=True)
class Fold:
    """A fold with a state of its own, as functions of pandas tables.

    update: rows (dst, message) of a task's edges -> rows (dst, state columns), one
    for each dst; merge: rows (dst, state columns), several for a dst -> one
    for each; commit: rows (dst, state columns) -> rows (dst, value columns).
    state and value name the columns and types between dst and the end, as in
    'a long, b double'. merge must be associative and commutative.
    """

    update: Callable[[pd.DataFrame], pd.DataFrame]
    merge: Callable[[pd.DataFrame], pd.DataFrame]
    commit: Callable[[pd.DataFrame], pd.DataFrame]
    state: str
    value: str


def _many_rows(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The rows of the batches, `least` at least at a time but for the last."""
    waiting, rows = [], 0
    for pdf in batches:
        if len(pdf):
            waiting.append(pdf)
            rows += len(pdf)
        if rows >= least:
            yield pd.concat(waiting, ignore_index=True)
            waiting, rows = [], 0
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def fold_edges(graph: Graph, state: DataFrame, message: Column, fold: Fold, frontier: DataFrame | None = None) -> DataFrame:
    """Rows (id, value columns) of the destinations that got a message.

    A task folds its edges FOLD_ROWS at a time and hands on one state for each
    of its destinations (more only where it holds more than MOST_FOLDED of
    them); states meet by destination and are merged in order of it, FOLD_ROWS
    at a time, so a hub is no more than the states of all tasks. A row is so
    folded a bounded number of times, however many destinations a task holds.
    message: a column over src, dst, w, eid and the source's state as s_name. A
    null message is handed to update like any other.
    """
    sources = state.select(*[F.col(c).alias("src" if c == "id" else f"s_{c}") for c in state.columns])
    edges = active_edges(graph, frontier).join(F.broadcast(sources) if graph.n <= MOST_PUSHED else sources, "src")
    names = [x.split()[0] for x in fold.state.split(",")]

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in _many_rows(batches, FOLD_ROWS):
            new = fold.update(pdf)
            held = new if held is None else fold.merge(pd.concat([held, new], ignore_index=True))
            if len(held) > MOST_FOLDED:
                yield held[["dst", *names]]
                held = None
        if held is not None:
            yield held[["dst", *names]]

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in _many_rows(batches, FOLD_ROWS):
            held = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            held = fold.merge(held).sort_values("dst", ignore_index=True)
            rest = held.iloc[-1:]  # may go on in the next rows
            if len(held) > 1:
                yield fold.commit(held.iloc[:-1].reset_index(drop=True))
        if rest is not None:
            yield fold.commit(rest.reset_index(drop=True))

    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = edges.select("dst", message.alias("message")).mapInPandas(gathered, f"dst long, {fold.state}")
    together = partial.repartition(parts, "dst").sortWithinPartitions("dst")
    return together.mapInPandas(merged, f"dst long, {fold.value}").withColumnRenamed("dst", "id")


def vertex_apply(state: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, frontier: DataFrame | None = None) -> DataFrame:
    """Rows that a vectorised function makes of batches of the state, or of the frontier's.

    fn: rows with the state's columns -> rows of schema, which may be more, fewer
    or none. It is never called without rows; nulls come as pandas has them.
    """
    rows = state if frontier is None else state.join(frontier.select("id"), "id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield fn(pdf)

    return rows.mapInPandas(run, schema)


def vertex_map(state: DataFrame, frontier: DataFrame | None = None, **columns: Column) -> DataFrame:
    """state with columns set, on the whole graph or on the frontier alone."""
    if frontier is None:
        return state.withColumns(columns)
    marked = state.join(frontier.select("id", F.lit(True).alias("__in")), "id", "left")
    return marked.withColumns({name: F.when(F.col("__in"), value).otherwise(F.col(name) if name in state.columns else None) for name, value in columns.items()}).drop("__in")


def vertex_filter(state: DataFrame, predicate: Column, frontier: DataFrame | None = None, **columns: Column) -> tuple[DataFrame, DataFrame]:
    """(new state, frontier of the vertices that meet the predicate after the columns are set).

    Both read one plan; hold the state before using both.
    """
    new = vertex_map(state, frontier, **columns)
    kept = new if frontier is None else new.join(frontier.select("id"), "id", "left_semi")
    return new, kept.filter(predicate).select("id")


def rem_duplicates(ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct()
