"""Edge- and vertex-balanced partitioners, subgraphs, relabelling and orders of edges."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hilbert_key
from ..graph import Graph
from .sequence import scan

#: Cells the candidates for a part are counted in, before as many are let in as it has room for.
CELLS = 1024


def by_source(graph: Graph, k: int) -> Graph:
    """An edge lies with its source."""
    return replace(graph, edges=graph.edges.repartition(k, "src"))


def by_destination(graph: Graph, k: int) -> Graph:
    """An edge lies with its destination, so that edge maps aggregate without another shuffle."""
    return replace(graph, edges=graph.edges.repartition(k, "dst"))


def block_of(k: int, halves: int = 2) -> Column:
    """The block of an edge: sources in `halves` rows by destinations in k // halves columns, row after row."""
    if k % halves:
        raise ValueError(f"{k} blocks don't make {halves} rows")
    row, column = F.pmod(F.xxhash64("src"), F.lit(halves)), F.pmod(F.xxhash64("dst"), F.lit(k // halves))
    return (row * (k // halves) + column).cast("int")


def two_d(graph: Graph, k: int, halves: int = 2) -> Graph:
    """Blocks of sources by blocks of destinations: block (i, j) is partition i * columns + j, so no two blocks share one."""
    return replace(graph, edges=graph.edges.repartitionById(k, block_of(k, halves)))


def by_parts(graph: Graph, parts: DataFrame, k: int, by: str = "dst", then: DataFrame | None = None, columns: int = 1) -> Graph:
    """Edges laid out by parts(id, part) of one end: part p is partition p of k.

    With then(id, part), parts of the other end in `columns` columns, the edge
    with parts (i, j) is in partition i * columns + j. Every vertex must have a
    part; one outside its range is an error.
    """
    other = "src" if by == "dst" else "dst"
    edges = graph.edges.join(parts.select(F.col("id").alias(by), F.col("part").alias("__i")), by)
    edges = edges.join(then.select(F.col("id").alias(other), F.col("part").alias("__j")), other) if then is not None else edges.withColumn("__j", F.lit(0))
    right = (F.col("__i") >= 0) & (F.col("__i") < k // columns) & (F.col("__j") >= 0) & (F.col("__j") < columns)
    at = F.when(right, F.col("__i") * columns + F.col("__j")).otherwise(F.raise_error(F.lit("a part is out of range")).cast("int"))
    return replace(graph, edges=edges.repartitionById(k, at.cast("int")).select("src", "dst", "w", "eid"))


def vertex_parts(graph: Graph, k: int) -> DataFrame:
    """(id, part): runs of n // k vertices by id; the last part takes the rest."""
    each = max(1, graph.n // k)
    placed = scan(graph.vertices.withColumn("__one", F.lit(1).cast("long")), "id", "__one", out="__at")
    return placed.select("id", F.least(F.expr(f"__at div {each}L"), F.lit(k - 1)).cast("int").alias("part"))


def degree_parts(graph: Graph, k: int, out: bool = False) -> DataFrame:
    """(id, part): runs of vertices by id with about m / k edges each, by in-degree or out-degree.

    A vertex goes to the part its edges begin in, so a part exceeds its share
    by less than the degree of one vertex.
    """
    degree = graph.degrees().select("id", F.col("out_degree" if out else "in_degree").alias("degree"))
    summed = scan(degree, "id", "degree", out="before")
    return summed.select("id", F.least(F.expr(f"before * {k}L div {max(1, graph.m)}L"), F.lit(k - 1)).cast("int").alias("part"))


def partition_approx(graph: Graph, k: int, slack: float = 0.1, rounds: int = 12, seed: int = 7) -> DataFrame:
    """(id, part): k parts that neighbours share where they can, none with more than ceil((1 + slack) * n / k) vertices.

    Begins with runs of n / k vertices. Each round, every vertex counts its
    neighbours' parts, in either direction; half of the vertices, another half
    each time, may move to the part with most of them. A part takes as many as
    it has room for, by the gain and then by a hash: candidates are counted in
    CELLS cells a part, and cells are let in until the next would overfill it,
    so the bound holds always, and no part's candidates meet in one task. Ends
    when no vertex of either half moves, or after `rounds`. Loops don't count.
    """
    from ..plans.layout import Layout
    from ..plans.loop import Rounds

    n = graph.n
    room = -int(-(1 + slack) * n // k)
    both = graph if graph.symmetric else graph.symmetrize()
    layout, held = Layout(both.edges.filter("src <> dst").select("src", "dst"), n), Rounds()
    placed = scan(graph.vertices.withColumn("__one", F.lit(1).cast("long")), "id", "__one", out="__at")
    state, still = placed.select("id", F.expr(f"cast(__at * {k}L div {max(1, n)}L as int)").alias("part")), 0
    state, _ = held.hold(layout.placed(state))
    for turn in range(rounds):
        sent = layout.meet(state.select(F.col("id").alias("src"), F.col("part").alias("vote"))).select(F.col("dst").alias("id"), "vote")
        votes = sent.groupBy("id", "vote").agg(F.count("*").alias("votes")).join(state, "id")
        best = votes.groupBy("id", "part").agg(F.max(F.struct("votes", (-F.col("vote")).alias("vote"))).alias("b"), F.coalesce(F.max(F.when(F.col("vote") == F.col("part"), F.col("votes"))), F.lit(0)).alias("own"))
        gain, turns = F.col("b.votes") - F.col("own"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2)) == turn % 2
        wants = best.filter((gain > 0) & turns).select("id", (-F.col("b.vote")).alias("to"), gain.alias("gain"))
        # Cells in order of falling gain (32 steps of its logarithm), then of a hash.
        step = F.least(F.floor(F.log2(F.col("gain"))), F.lit(31)).cast("int")
        wants = wants.withColumn("cell", ((31 - step) * (CELLS // 32) + F.pmod(F.xxhash64(F.lit(seed + 1 + turn), "id"), F.lit(CELLS // 32))).cast("int"))
        loads = {r.part: r.n for r in state.groupBy("part").agg(F.count("*").alias("n")).collect()}
        free = {p: room - loads.get(p, 0) for p in range(k)}
        cells = wants.groupBy("to", "cell").agg(F.count("*").alias("n")).orderBy("to", "cell").collect()  # k * CELLS rows at most
        last: dict[int, int] = {}
        for r in cells:
            if free[r.to] >= 0:
                free[r.to] -= r.n
                if free[r.to] >= 0:
                    last[r.to] = r.cell
        if not last:
            still += 1
            if still == 2:
                break
            continue
        still = 0
        bound = F.create_map(*[F.lit(x) for p in last.items() for x in p])
        moves = wants.filter(F.col("cell") <= F.coalesce(F.try_element_at(bound, F.col("to")), F.lit(-1))).select("id", "to")
        state, _ = held.hold(layout.placed(state.join(moves, "id", "left").select("id", F.coalesce("to", "part").cast("int").alias("part"))))
    layout.free()
    return state


def cut_edges(graph: Graph, parts: DataFrame) -> DataFrame:
    """One row: edges, and those whose ends have different parts."""
    ends = [parts.select(F.col("id").alias(c), F.col("part").alias(f"__{c}")) for c in ("src", "dst")]
    return graph.edges.join(ends[0], "src").join(ends[1], "dst").agg(F.count("*").alias("edges"), F.count_if(F.col("__src") != F.col("__dst")).alias("cut"))


def by_rank(parts: DataFrame) -> DataFrame:
    """mapping(old, new) for relabel(): vertices numbered from 0 by part, then by id, so that parts are runs of ids."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    span = sizes.agg(F.min("low"), F.max("high")).first()
    width = (span[1] - span[0] + 1) if span[0] is not None else 1
    keyed = parts.select("id", (F.col("part").cast("long") * width + (F.col("id") - (span[0] or 0))).alias("__key"), F.lit(1).cast("long").alias("__one"))
    return scan(keyed, "__key", "__one", out="__new").select(F.col("id").alias("old"), F.col("__new").alias("new"))


def part_sizes(graph: Graph, parts: DataFrame, by: str = "dst") -> DataFrame:
    """(part, vertices, edges): no edge is lost or counted twice."""
    edges = graph.edges.join(parts.withColumnRenamed("id", by), by).groupBy("part").agg(F.count("*").alias("edges"))
    return parts.groupBy("part").agg(F.count("*").alias("vertices")).join(edges, "part", "left").select("part", "vertices", F.coalesce("edges", F.lit(0)).alias("edges"))


def subgraph(graph: Graph, keep: Column | DataFrame) -> Graph:
    """The edges with both ends among the kept vertices: a predicate on id, or a table of ids."""
    if isinstance(keep, DataFrame):
        kept = keep.select("id")
    else:
        kept = graph.vertices.filter(keep)
    edges = graph.edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(kept, edges.select("src", "dst", "w", "eid"), graph.symmetric)


def relabel(graph: Graph, mapping: DataFrame) -> Graph:
    """Vertices renamed by mapping(old, new), which must name every vertex once."""
    src, dst = (mapping.select(F.col("old").alias(c), F.col("new").alias(f"__{c}")) for c in ("src", "dst"))
    edges = graph.edges.join(src, "src").join(dst, "dst").select(F.col("__src").alias("src"), F.col("__dst").alias("dst"), "w", "eid")
    return Graph(graph.vertices.join(mapping, F.col("id") == F.col("old")).select(F.col("new").alias("id")), edges, graph.symmetric)


def hilbert_order(graph: Graph, k: int, bits: int = 31) -> DataFrame:
    """Edges with their Hilbert key h, ranged and sorted by it: neighbours on the curve share a partition."""
    keyed = graph.edges.withColumn("h", hilbert_key(F.col("src"), F.col("dst"), bits))
    return keyed.repartitionByRange(k, "h").sortWithinPartitions("h")


def destination_order(graph: Graph, k: int) -> DataFrame:
    """Edges ranged and sorted by destination, then source."""
    return graph.edges.repartitionByRange(k, "dst", "src").sortWithinPartitions("dst", "src")
