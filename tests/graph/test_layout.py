"""Programs where no state may be broadcast, cut hubs, indexed frontiers, and what a program leaves behind."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_programs import got, graph

from loomgraph.graph import from_edges
from loomgraph.operators import edge_map
from loomgraph.plans import algorithms as a
from loomgraph.plans.layout import Index, Layout, indexed
from loomgraph.plans.loop import Rounds, shared_dir


@pytest.fixture(scope="module")
def mixed(spark):
    """A hub, a path, loops, parallel edges and isolated vertices."""
    rng = random.Random(3)
    edges = [(0, k, 1 + k % 5) for k in range(1, 60)] + [(k, k + 1, 2) for k in range(60, 75)] + [(3, 60, 1), (9, 9, 1), (0, 5, 1)]
    edges += [(rng.randrange(90), rng.randrange(60), rng.randrange(1, 9)) for _ in range(150)]
    return graph(spark, edges, 100)


PROGRAMS = {
    "bfs": lambda g: got(a.bfs(g, 0), "level", "parent"),
    "betweenness": lambda g: {k: (v[0], v[1], None if v[2] is None else round(v[2], 9)) for k, v in got(a.betweenness(g, 0), "level", "sigma", "delta").items()},
    "components": lambda g: got(a.components(g), "label"),
    "undirected": lambda g: got(a.components(g, "undirected"), "label"),
    "pagerank": lambda g: {k: round(v, 12) for k, v in got(a.pagerank(g, most_rounds=4), "rank").items()},
    "pagerank_delta": lambda g: {k: round(v, 12) for k, v in got(a.pagerank_delta(g, most_rounds=5), "rank").items()},
    "bellman_ford": lambda g: got(a.bellman_ford(g, 0), "dist"),
}


@pytest.mark.parametrize("program", PROGRAMS)
def test_programs_without_broadcast_states(mixed, monkeypatch, program):
    want = PROGRAMS[program](mixed)
    monkeypatch.setattr(edge_map, "MOST_PUSHED", 3)
    monkeypatch.setattr("loomgraph.plans.layout.HUB_SHARE", 2)  # several hubs
    assert PROGRAMS[program](mixed) == want


def test_beliefs_without_broadcast_states(spark, mixed, monkeypatch):
    v = mixed.vertices.select("id", F.lit(0.6).alias("psi0"), (0.1 + F.col("id") % 7 / 10).alias("psi1"))
    e = mixed.edges.select("src", "dst", "eid", F.lit(0.9).alias("psi00"), F.lit(0.1).alias("psi01"), F.lit(0.2).alias("psi10"), F.lit(0.8).alias("psi11"))
    run = lambda: {k: tuple(round(x, 9) for x in v) for k, v in got(a.belief_propagation(mixed, v, e, rounds=3, logs=True), "product0", "product1").items()}
    want = run()
    monkeypatch.setattr(edge_map, "MOST_PUSHED", 3)
    assert run() == want


def test_a_star_is_dealt_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(edge_map, "MOST_PUSHED", 10)
    star = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    rest = spark.range(200_000).select((F.col("id") % 5000 + 1).alias("src"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("dst"))
    layout = Layout(star.unionByName(rest), 1_000_001)
    assert [r.src for r in layout.hubs.collect()] == [0]
    state = spark.range(1_000_001).select(F.col("id").alias("src"), F.lit(1.0).alias("x"))
    tables = [layout.plain, layout.dealt]
    rows = [sorted(r["count"] for r in t.groupBy(F.spark_partition_id()).count().collect()) for t in tables]
    for each in rows:
        assert len(each) == layout.parts and each[-1] <= 2 * each[len(each) // 2]
    met = layout.meet(state)
    assert met.count() == 1_200_000
    plan = met._jdf.queryExecution().executedPlan().toString()
    moved = plan.split("InMemoryTableScan")[0]
    assert "Union" in moved and "left_semi" not in moved  # the hub's part is a broadcast join of its own
    layout.free()


def test_what_hubs_send_is_folded_where_it_arrives(spark, monkeypatch):
    """Customers that all buy from the same suppliers: a round hands on few partial sums, and sorts no edges."""
    monkeypatch.setattr(edge_map, "MOST_PUSHED", 40)
    monkeypatch.setattr("loomgraph.plans.layout.FOLDED_EDGES", 10**9)
    pairs = spark.range(60_000).select((F.col("id") % 3000 + 100).alias("a"), (F.xxhash64("id") % 20).alias("b"))
    pairs = pairs.select("a", F.abs("b").alias("b"))
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    g = from_edges(edges, symmetric=True).cached()
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        layout = Layout.of(g)
        assert {r.src for r in layout.hubs.collect()} == set(range(20))  # twenty of 3,000 edges each, the others have twenty
        lists = layout.plain
        assert lists.count() == 3000 and lists.selectExpr("sum(size(__list))").first()[0] == 60_000
        sent = layout.meet(g.vertices.select(F.col("id").alias("src"), F.lit(1).alias("got"))).select(F.col("dst").alias("id"), "got", F.spark_partition_id().alias("task"))
        assert sent.count() == g.m
        assert sent.select("id", "task").distinct().count() <= 3000 + 16 + 20 * spark.sparkContext.defaultParallelism
        want = {r.dst: r.n for r in edges.groupBy("dst").agg(F.count("*").alias("n")).collect()}
        assert {r.id: r.got for r in sent.groupBy("id").agg(F.sum("got").alias("got")).collect()} == want
        own = Layout.of(g, on="dst", own=True)
        assert own.dealt is None or {r.dst for r in own.hubs.collect()} <= set(range(20))
        layout.free()
        own.free()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        g.unpersist()


def test_vertices_are_made_from_held_edges(spark):
    """Once edges are held, nothing derives them a second time."""
    g = from_edges(spark.range(50).select((F.col("id") * 2).alias("src"), (F.col("id") * 2 + 1).alias("dst"))).cached()
    assert "InMemoryTableScan" in g.vertices._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation", 1)[1]
    assert sorted(r.id for r in g.vertices.collect()) == list(range(100))
    g.unpersist()


def test_degrees_of_symmetric_graphs(spark):
    edges = [(1, 2), (2, 1), (2, 2), (1, 2), (2, 1)]
    g = graph(spark, edges, 4, True)
    assert got(g.degrees(), "out_degree", "in_degree") == {0: (0, 0), 1: (2, 2), 2: (3, 3), 3: (0, 0)}
    g.unpersist()


def _own_exchanges(df):
    """Exchanges of the plan that ran, without those that made the cached tables it reads."""
    out, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*("))
        if inside is not None and depth > inside:
            continue
        inside = depth if "InMemoryRelation" in line else None
        if "== Initial Plan" in line:
            break
        if "Exchange" in line:
            out.append(line.strip(" :+-"))
    return out


def test_rounds_of_a_large_state_move_messages_only(spark, monkeypatch):
    monkeypatch.setattr(edge_map, "MOST_PUSHED", 3)
    monkeypatch.setattr("loomgraph.plans.layout.HUB_SHARE", 1)
    g = graph(spark, [(k % 90, k * 7 % 100) for k in range(300)], 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layout = Layout(g.edges.select("src", "dst"), g.n)
        assert layout.dealt is None
        state = layout.placed(g.vertices.select("id", F.lit(1.0).alias("x"))).persist()
        state.count()
        sent = layout.meet(state.select(F.col("id").alias("src"), F.col("x").alias("got"))).select(F.col("dst").alias("id"), "got")
        merged = layout.placed(layout.merged(state, sent, got=F.sum("got")))
        assert len(merged.collect()) == 100
        # Neither the edges nor the state move: the one exchange is that of the partial sums.
        own = _own_exchanges(merged)
        assert len(own) == 1 and "hashpartitioning(id" in own[0] and "REPARTITION" not in own[0], own
        state.unpersist()
        layout.free()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _files_read(spark, df):
    """Rows of df, and files that its scans read, by the scans' own metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    rows = df.collect()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    files, listed = 0, store.executionsList(before, 100)
    for k in range(listed.size()):
        run = listed.apply(k)
        names = {run.metrics().apply(i).accumulatorId(): run.metrics().apply(i).name() for i in range(run.metrics().size())}
        values = store.executionMetrics(run.executionId())
        files += sum(int(values.get(i).get().replace(",", "")) for i, name in names.items() if name == "number of files read" and values.contains(i))
    return rows, files


def test_an_index_reads_the_ranges_of_the_frontier(spark):
    n = 4000
    path = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).cast("long").alias("w"))
    index = Index(path, 20)
    assert len(os.listdir(index.path.removeprefix("file:"))) >= 18
    front = spark.range(n).filter("id in (7, 3990)").select(F.col("id").alias("src"), F.lit("x").alias("mark"))
    rows, files = _files_read(spark, index.meet(front))
    assert sorted((r.src, r.dst, r.mark) for r in rows) == [(7, 8, "x"), (3990, 3991, "x")]
    assert 1 <= files <= 2
    assert _files_read(spark, index.edges)[1] >= 18
    index.free()
    assert not os.path.exists(index.path.removeprefix("file:"))


def test_programs_read_an_index(spark, mixed):
    path = graph(spark, [(k, k + 1, 1) for k in range(5)] + [(100 + k, 200 + k, 1) for k in range(300)] , 600)
    held = indexed(path, 8)
    asked = []
    meet = held.index.meet
    held.index.meet = lambda state: asked.append(1) or meet(state)
    for name in ("bfs", "betweenness", "bellman_ford"):
        assert PROGRAMS[name](held) == PROGRAMS[name](path)
    assert len(asked) >= 8
    empty = Index(path.edges.limit(0))
    assert empty.meet(spark.range(3).select(F.col("id").alias("src"))).count() == 0


def test_dense_levels_send_nothing_to_what_is_reached(spark, monkeypatch):
    rng = random.Random(1)
    g = graph(spark, [e for _ in range(2500) for x, y in [(rng.randrange(60), rng.randrange(60))] for e in ((x, y), (y, x))], 60)
    pulled = []
    found = a._Levels.found

    def watched(self, state, level, *columns):
        out = found(self, state, level, *columns)
        if self.pulls:
            reached = state.filter("level is not null").select(F.col("id").alias("dst"))
            pulled.append(out.join(reached, "dst", "left_semi").count())
        return out

    want = got(a.bfs(g, 0), "level", "parent")
    monkeypatch.setattr(a._Levels, "found", watched)
    assert got(a.bfs(g, 0), "level", "parent") == want and pulled and not any(pulled)
    monkeypatch.setattr(edge_map, "MOST_PUSHED", 3)
    pulled.clear()
    assert got(a.bfs(g, 0), "level", "parent") == want and pulled and not any(pulled)


def test_a_long_path_leaves_two_states_at_most(spark):
    g = graph(spark, [(k, k + 1) for k in range(36)], 37)
    g.held_degrees.count()
    tables = lambda: {f for f in os.listdir(shared_dir(spark).removeprefix("file:"))}
    before, held = tables(), spark._jsc.sc().getPersistentRDDs().size()
    out = a.bfs(g, 0)
    assert len(tables() - before) <= 1 and spark._jsc.sc().getPersistentRDDs().size() - held <= 1
    assert got(out, "level") == {k: k for k in range(37)}


def test_metrics_come_from_the_job_that_makes_the_state(spark):
    rounds = Rounds(every=2)
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    for _ in range(4):
        kept, (n, total) = rounds.hold(df, F.count("*"), F.sum("x"))
        assert (n, total, kept.count()) == (50, 2450, 50)
    kept, (n,) = rounds.hold(df, F.count("*"))
    kept, (n, total) = rounds.hold(df.limit(0), F.count("*"), F.sum("x"))
    assert (n, total) == (0, None) and kept.count() == 0
    rounds.free()
