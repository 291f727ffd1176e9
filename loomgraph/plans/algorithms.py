"""The programs: traversal, centrality, components, ranks, shortest paths, products, beliefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import edge_map
from ..operators.edge_map import EdgeFn
from .layout import Layout
from .loop import Rounds

#: What stands for no path, and for a distance below all bounds.
INFINITE = (2**31 - 1) // 2


def _start(graph: Graph, source: int | None = None) -> DataFrame:
    """(id, out_degree, in_degree); an error if the source isn't in the graph."""
    if source is not None and graph.vertices.filter(F.col("id") == source).isEmpty():
        raise ValueError(f"vertex {source} is not in the graph")
    return graph.held_degrees


class _Levels:
    """Breadth-first levels: from the frontier's side while its out-edges are few, else from the side of what is not reached.

    state(id, out_degree, in_degree, level, ...) has every vertex, level null
    where it isn't reached. Both ways give the same pairs of a vertex on the
    level before and an unreached one; the first reads the frontier's edges (by
    the graph's index, if it has one), the second the in-edges of the unreached,
    so that nothing is sent to vertices that have their level. Where states are
    broadcast both ends are looked up in one pass over the edges.
    """

    def __init__(self, graph: Graph):
        self.graph, self.forth, self._back = graph, Layout.of(graph), None
        self.size, self.out_edges, self.left, self.left_edges = 1, 0, graph.n, 0

    #: Vertices and out-edges of the frontier; unreached vertices and their in-edges.
    @staticmethod
    def counts(level: int) -> list[Column]:
        front, rest = F.col("level") == level, F.col("level").isNull()
        return [F.count_if(front), F.sum(F.when(front, F.col("out_degree"))), F.count_if(rest), F.sum(F.when(rest, F.col("in_degree")))]

    def took(self, values: list) -> None:
        self.size, self.out_edges, self.left, self.left_edges = (x or 0 for x in values)

    @property
    def sparse(self) -> bool:
        return edge_map.is_sparse(self.graph, self.size, self.out_edges)

    @property
    def pulls(self) -> bool:
        return not self.sparse and (self.forth.small or self.left_edges < self.out_edges)

    def found(self, state: DataFrame, level: int, *columns: str) -> DataFrame:
        """(dst, src, columns of the source): edges from the frontier, of `level`, into what isn't reached."""
        front = state.filter(F.col("level") == level).select(F.col("id").alias("src"), *columns)
        rest = state.filter("level is null").select(F.col("id").alias("dst"))
        few = self.size <= edge_map.MOST_PUSHED
        if self.pulls and not self.forth.small:
            if self._back is None:
                self._back = Layout.of(self.graph, on="dst", own=True)
            return self._back.meet(rest, self.left).join(F.broadcast(front) if few else front, "src")
        met = self.forth.meet(front, self.size, self.sparse)
        return met.join(F.broadcast(rest), "dst") if self.pulls else met

    def free(self) -> None:
        self.forth.free()
        if self._back is not None:
            self._back.free()


def bfs(graph: Graph, source: int, with_unreached: bool = False) -> DataFrame:
    """(id, level, parent): hops from the source; the least neighbour on the level before is the parent, the source its own.

    Vertices out of reach have no row, or level and parent -1 if with_unreached.
    """
    own = F.when(F.col("id") == source, F.lit(0))
    state = _start(graph, source).withColumns({"level": own, "parent": F.when(F.col("id") == source, F.col("id"))})
    rounds, levels, level = Rounds(), _Levels(graph), 0
    while levels.size and levels.left:
        sent = levels.found(state, level).select(F.col("dst").alias("id"), F.col("src").alias("by"))
        level += 1
        merged = levels.forth.merged(state, sent, by=F.min("by"))
        new = F.col("level").isNull() & F.col("by").isNotNull()
        merged = merged.select("id", "out_degree", "in_degree", F.when(new, F.lit(level)).otherwise(F.col("level")).alias("level"), F.when(new, F.col("by")).otherwise(F.col("parent")).alias("parent"))
        state, values = rounds.hold(merged, *levels.counts(level))
        levels.took(values)
    levels.free()
    if with_unreached:
        return state.select("id", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("parent", F.lit(-1)).alias("parent"))
    return state.filter("level is not null").select("id", "level", "parent")


def betweenness(graph: Graph, source: int) -> DataFrame:
    """(id, level, sigma, delta): shortest paths from the source and dependencies on it (Brandes), the source's own included.

    Vertices out of reach have nulls. Parallel edges count as paths of their own.
    One table holds levels, paths and dependencies; each level is one
    aggregation there, and one back, of what the level below sends to this one.
    """
    own = F.col("id") == source
    state = _start(graph, source).withColumns({"level": F.when(own, F.lit(0)), "sigma": F.when(own, F.lit(1.0))})
    rounds, levels, level, sizes = Rounds(), _Levels(graph), 0, [1]
    while levels.size and levels.left:
        sent = levels.found(state, level, "sigma").select(F.col("dst").alias("id"), F.col("sigma").alias("part"))
        level += 1
        new = F.col("level").isNull() & F.col("part").isNotNull()
        merged = levels.forth.merged(state, sent, part=F.sum("part"))
        merged = merged.select("id", "out_degree", "in_degree", F.when(new, F.lit(level)).otherwise(F.col("level")).alias("level"), F.when(new, F.col("part")).otherwise(F.col("sigma")).alias("sigma"))
        state, values = rounds.hold(merged, *levels.counts(level))
        levels.took(values)
        sizes.append(levels.size)
    levels.forth.free()
    state = state.select("id", "level", "sigma", F.when(F.col("level").isNotNull(), F.lit(0.0)).alias("delta"))
    back = Layout.of(graph, on="dst")
    last = max(k for k, size in enumerate(sizes) if size)
    for k in range(last - 1, -1, -1):
        child = state.filter(F.col("level") == k + 1).select(F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        parent = state.filter(F.col("level") == k).select(F.col("id").alias("src"))
        sent = back.meet(child, sizes[k + 1]).join(F.broadcast(parent) if sizes[k] <= edge_map.MOST_PUSHED else parent, "src").select(F.col("src").alias("id"), "share")
        merged = back.merged(state, sent, share=F.sum("share"))
        delta = F.when(F.col("share").isNotNull(), F.col("sigma") * F.col("share")).otherwise(F.col("delta"))
        state, _ = rounds.hold(merged.select("id", "level", "sigma", delta.alias("delta")))
    back.free()
    return state


def radii(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(id, radius): the hops from the farthest of up to 64 sources that reach a vertex, -1 where none does.

    All sources are searched from at once: bit i of a vertex's mask is set once
    source i reaches it, masks are merged by `or`, and only vertices whose mask
    has changed send theirs. In a symmetric graph a vertex's eccentricity within
    its component is the radius at least. sources(id) are 64 vertices at most,
    64 by the hash of their id where not given; it is an error if they are more.
    """
    if sources is None:
        sources = graph.vertices.orderBy(F.xxhash64("id"), "id").limit(64)
    ids = sorted({r.id for r in sources.select("id").limit(65).collect()})
    if len(ids) > 64:
        raise ValueError("a mask has 64 bits")
    bits = F.create_map(*[F.lit(x) for k, i in enumerate(ids) for x in (i, (1 << k) - (1 << 64 if k == 63 else 0))]) if ids else F.create_map().cast("map<bigint,bigint>")
    rounds, layout, k = Rounds(), Layout.of(graph), 0
    state = _start(graph).select("id", "out_degree", F.coalesce(F.try_element_at(bits, F.col("id")).cast("long"), F.lit(0).cast("long")).alias("mask"))
    state = state.withColumns({"radius": F.when(F.col("mask") != 0, F.lit(0)).otherwise(-1), "changed": F.col("mask") != 0})
    size, out_edges = len(ids), 0
    while size:
        k += 1
        front = state.filter("changed").select(F.col("id").alias("src"), F.col("mask").alias("seen"))
        sent = layout.meet(front, size, edge_map.is_sparse(graph, size, out_edges)).select(F.col("dst").alias("id"), "seen")
        both = layout.merged(state.drop("changed"), sent, seen=F.bit_or("seen"))
        new = F.col("mask").bitwiseOR(F.coalesce("seen", F.lit(0).cast("long")))
        new = both.select("id", "out_degree", new.alias("mask"), F.when(new != F.col("mask"), F.lit(k)).otherwise(F.col("radius")).alias("radius"), (new != F.col("mask")).alias("changed"))
        state, (size, out_edges) = rounds.hold(new, F.count_if("changed"), F.coalesce(F.sum(F.when(F.col("changed"), F.col("out_degree"))), F.lit(0)))
    layout.free()
    return state.select("id", "radius")


def components(graph: Graph, mode: str | None = None) -> DataFrame:
    """(id, label): the least id among a vertex and all that reach it.

    mode 'propagate' follows edges as they are directed, 'undirected' ignores
    direction; the default is the former, which for a symmetric graph is its
    connected components. Only labels that changed are sent. A label's own label
    is taken each round, so long chains need few rounds.
    """
    if mode not in (None, "propagate", "undirected"):
        raise ValueError(mode)
    edges = (graph.symmetrize() if mode == "undirected" else graph).edges.select("src", "dst").filter("src <> dst")
    rounds, layout, n = Rounds(), Layout(edges, graph.n), graph.n
    state, changed = graph.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("changed")), n
    while changed:
        front = state.filter("changed").select(F.col("id").alias("src"), F.col("label").alias("near"))
        sent = layout.meet(front, changed).select(F.col("dst").alias("id"), "near")
        lower = F.least("label", "near")
        spread = layout.merged(state.select("id", "label"), sent, near=F.min("near")).select("id", lower.alias("label"), (lower < F.col("label")).alias("changed"))
        spread, (changed,) = rounds.hold(spread, F.count_if("changed"))
        state = spread
        if changed:
            jump = spread.select(F.col("id").alias("label"), F.col("label").alias("further"))
            jumped = spread.join(F.broadcast(jump) if layout.small else jump, "label")
            lower = F.least("label", "further")
            jumped = jumped.select("id", lower.alias("label"), (F.col("changed") | (lower < F.col("label"))).alias("changed"))
            state, (changed,) = rounds.hold(layout.placed(jumped), F.count_if("changed"))
    layout.free()
    return state.select("id", "label")


def pagerank(graph: Graph, damping: float = 0.85, most_rounds: int = 10, tolerance: float = 1e-7) -> DataFrame:
    """(id, rank). The mass of vertices without out-edges is dropped; stops after most_rounds, or when the sum of changes is below tolerance."""
    n = graph.n
    if not n:
        return graph.vertices.select("id", F.lit(0.0).alias("rank"))
    rounds, layout = Rounds(), Layout.of(graph)
    state = _start(graph).select("id", "out_degree", F.lit(1.0 / n).alias("rank"))
    for _ in range(most_rounds):
        shares = state.filter("out_degree > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("out_degree")).alias("got"))
        sent = layout.meet(shares).select(F.col("dst").alias("id"), "got")
        new = damping * F.coalesce("got", F.lit(0.0)) + (1 - damping) / n
        moved = layout.merged(state, sent, got=F.sum("got")).select("id", "out_degree", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved"))
        held, (moved,) = rounds.hold(moved, F.sum("moved"))
        state = held.select("id", "out_degree", "rank")
        if moved < tolerance:
            break
    layout.free()
    return state.select("id", "rank")


def pagerank_delta(graph: Graph, damping: float = 0.85, tolerance: float = 1e-7, threshold: float = 0.01, most_rounds: int | None = None) -> DataFrame:
    """(id, rank, delta, active): ranks by the changes of active vertices alone.

    A vertex is active while its change exceeds threshold times its rank; stops
    when the changes of all vertices sum to less than tolerance.
    """
    n = graph.n
    if not n:
        return graph.vertices.select("id", F.lit(0.0).alias("rank"), F.lit(0.0).alias("delta"), F.lit(False).alias("active"))
    layout = Layout.of(graph)
    state = _start(graph).select("id", "out_degree", F.lit(0.0).alias("rank"), F.lit(1.0 / n).alias("delta"), F.lit(True).alias("active"))
    rounds, k, size, out_edges = Rounds(), 0, n, graph.m
    while most_rounds is None or k < most_rounds:
        k += 1
        sparse = edge_map.is_sparse(graph, size, out_edges)
        shares = state.filter("active and out_degree > 0").select(F.col("id").alias("src"), (F.col("delta") / F.col("out_degree")).alias("part"))
        sent = layout.meet(shares, size, sparse).select(F.col("dst").alias("id"), "part")
        both = layout.merged(state.select("id", "out_degree", "rank"), sent, part=F.sum("part"))
        got = F.coalesce("part", F.lit(0.0))
        if k == 1:
            step = damping * (F.col("rank") + got) + (1 - damping) / n - F.col("rank")
            new = both.select("id", "out_degree", (F.col("rank") + step).alias("rank"), (step - 1.0 / n).alias("delta"))
        else:
            new = both.select("id", "out_degree", (F.col("rank") + damping * got).alias("rank"), (damping * got).alias("delta"))
        state, (moved, size, out_edges) = rounds.hold(new.withColumn("active", F.abs("delta") > threshold * F.col("rank")), F.sum(F.abs("delta")), F.count_if("active"), F.coalesce(F.sum(F.when(F.col("active"), F.col("out_degree"))), F.lit(0)))
        if moved < tolerance:
            break
    layout.free()
    return state.select("id", "rank", "delta", "active")


def _has_cycle(parents: DataFrame, n: int) -> bool:
    """Whether the pointers (id, parent) of n vertices at most run in a circle: whether any are left after n steps, doubled each time."""
    rounds, covered = Rounds(), 1
    jumps, (left,) = rounds.hold(parents.filter("parent is not null").select("id", "parent"))
    while left and covered <= n:
        on = jumps.select(F.col("id").alias("parent"), F.col("parent").alias("further"))
        jumps, (left,) = rounds.hold(jumps.join(on, "parent").select("id", F.col("further").alias("parent")))
        covered *= 2
    rounds.free()
    return left > 0


def bellman_ford(graph: Graph, source: int, with_unreached: bool = False) -> DataFrame:
    """(id, dist): least sums of weights from the source.

    If distances still fall after as many rounds as there are vertices, a
    negative cycle is within reach and every vertex gets -INFINITE. Where whole
    weights are negative, the edges that gave the distances are followed back
    after 2, 4, 8, ... rounds: they run in a circle only on a negative cycle, so
    that most are known long before. Vertices out of reach have no row, or
    INFINITE if with_unreached.
    """
    n, rounds = graph.n, Rounds()
    weight = dict(graph.edges.dtypes)["w"]
    traced = weight in ("tinyint", "smallint", "int", "bigint") and not graph.edges.filter("w < 0").isEmpty()
    layout = Layout.of(graph, "w")
    own = F.col("id") == source
    state = _start(graph, source).select("id", "out_degree", F.when(own, F.lit(0)).cast(weight).alias("dist"), F.lit(None).cast("long").alias("parent"), own.alias("changed"))
    size, out_edges, k = 1, 0, 0
    while size:
        if k == n or (traced and k > 1 and k & (k - 1) == 0 and _has_cycle(state.select("id", "parent"), n)):
            layout.free()
            rounds.free()
            return graph.vertices.select("id", F.lit(-INFINITE).cast(weight).alias("dist"))
        k += 1
        front = state.filter("changed").select(F.col("id").alias("src"), F.col("dist").alias("so_far"))
        sent = layout.meet(front, size, edge_map.is_sparse(graph, size, out_edges)).select(F.col("dst").alias("id"), (F.col("so_far") + F.col("w")).alias("way"), *([F.col("src").alias("by")] if traced else []))
        folds = {"best": F.min("way")} | ({"from": F.min_by("by", "way")} if traced else {})
        new = layout.merged(state.drop("changed"), sent, **folds)
        better = F.col("best").isNotNull() & (F.col("dist").isNull() | (F.col("best") < F.col("dist")))
        parent = F.when(better, F.col("from")).otherwise(F.col("parent")) if traced else F.col("parent")
        new = new.select("id", "out_degree", F.least("dist", "best").alias("dist"), parent.alias("parent"), better.alias("changed"))
        state, (size, out_edges) = rounds.hold(new, F.count_if("changed"), F.coalesce(F.sum(F.when(F.col("changed"), F.col("out_degree"))), F.lit(0)))
    layout.free()
    if with_unreached:
        return state.select("id", F.coalesce("dist", F.lit(INFINITE).cast(weight)).alias("dist"))
    return state.filter("dist is not null").select("id", "dist")


def spmv(graph: Graph, x: DataFrame | None = None) -> DataFrame:
    """(id, y): y of a vertex sums x of the source times the weight over its in-edges; x(id, x) is 1 / n where not given."""
    if x is None:
        got = graph.edges.groupBy(F.col("dst").alias("id")).agg((F.sum("w") / F.lit(float(max(graph.n, 1)))).alias("y"))
    else:
        got = edge_map.edge_map(graph, x, EdgeFn(F.col("s_x") * F.col("w"))).select("id", F.col("value").alias("y"))
    return graph.vertices.join(got, "id", "left").select("id", F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"))


def belief_propagation(graph: Graph, vertex_potentials: DataFrame, edge_potentials: DataFrame, rounds: int = 10, logs: bool = False) -> DataFrame:
    """(id, product0, product1) for two states, or their logarithms.

    vertex_potentials(id, psi0, psi1), edge_potentials(src, dst, eid, psi00,
    psi01, psi10, psi11). Each round an edge's belief in state i is the sum over
    j of the destination's potential j, the edge's potential ij and the
    destination's product j; the product over in-edges is the new product of
    the destination, 1 where there are none. logs works with logarithms, which
    don't underflow; potentials must then be positive.
    """
    held, state = Rounds(), vertex_potentials.select("id", "psi0", "psi1", F.lit(0.0 if logs else 1.0).alias("a"), F.lit(0.0 if logs else 1.0).alias("b"))
    layout = Layout(edge_potentials.select("dst", "psi00", "psi01", "psi10", "psi11"), graph.n, "dst", own=True)

    def belief(i: int) -> Column:
        if not logs:
            return F.col("psi0") * F.col(f"psi{i}0") * F.col("a") + F.col("psi1") * F.col(f"psi{i}1") * F.col("b")
        top = F.greatest("a", "b")
        return top + F.log(F.col("psi0") * F.col(f"psi{i}0") * F.exp(F.col("a") - top) + F.col("psi1") * F.col(f"psi{i}1") * F.exp(F.col("b") - top))

    fold, empty = (F.sum, 0.0) if logs else (F.product, 1.0)
    for _ in range(rounds):
        met = layout.meet(state.withColumnRenamed("id", "dst"))
        sent = met.select(F.col("dst").alias("id"), belief(0).alias("b0"), belief(1).alias("b1"))
        new = layout.merged(state, sent, p0=fold("b0"), p1=fold("b1"))
        state, _ = held.hold(new.select("id", "psi0", "psi1", F.coalesce("p0", F.lit(empty)).alias("a"), F.coalesce("p1", F.lit(empty)).alias("b")))
    layout.free()
    return state.select("id", F.col("a").alias("product0"), F.col("b").alias("product1"))
