"""Golden values on a six-vertex graph, hand-made cases, and random graphs against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph import queries
from loomgraph.graph import from_edges
from loomgraph.plans import algorithms as a

SIX = {0: [1, 2], 1: [2, 4], 2: [1, 4, 5], 3: [0, 2, 4], 4: [0, 1, 2, 5], 5: [1]}


def graph(spark, edges, n, symmetric=False):
    rows = [(s, d, *w) if w else (s, d, 1) for s, d, *w in edges]
    return from_edges(spark.createDataFrame(rows, "src long, dst long, w long"), spark.range(n), symmetric).cached()


@pytest.fixture(scope="module")
def six(spark):
    return graph(spark, [(s, d) for s, ds in SIX.items() for d in ds], 6)


def got(df, *cols):
    return {r[0]: r[1] if len(cols) == 1 else tuple(r[1:]) for r in df.select("id", *cols).collect()}


def test_bfs(six):
    assert got(a.bfs(six, 0), "level", "parent") == {0: (0, 0), 1: (1, 0), 2: (1, 0), 4: (2, 1), 5: (2, 2)}
    assert got(a.bfs(six, 0, with_unreached=True), "level")[3] == -1
    with pytest.raises(ValueError):
        a.bfs(six, 100)


def test_betweenness(six):
    out = got(a.betweenness(six, 0), "sigma", "delta")
    assert out[3] == (None, None)
    assert {k: v for k, v in out.items() if k != 3} == {0: (1, 4.0), 1: (1, 0.5), 2: (1, 1.5), 4: (2, 0.0), 5: (1, 0.0)}


def test_shortest_paths(six):
    assert got(a.bellman_ford(six, 0, with_unreached=True), "dist") == {0: 0, 1: 1, 2: 1, 3: a.INFINITE, 4: 2, 5: 2}


def test_components(six):
    assert got(a.components(six), "label") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 0}
    assert set(got(a.components(six, "undirected"), "label").values()) == {0}


def test_ranks(six):
    want = [0.079668, 0.293051, 0.238161, 0.025, 0.224107, 0.140013]
    assert [round(v, 6) for _, v in sorted(got(a.pagerank(six), "rank").items())] == want
    want = [0.079028, 0.290239, 0.237298, 0.025, 0.223467, 0.138963]
    assert [round(v, 6) for _, v in sorted(got(a.pagerank_delta(six), "rank").items())] == want


def test_spmv(six):
    want = [0.333333, 0.666667, 0.666667, 0, 0.5, 0.333333]
    assert [round(v, 6) for _, v in sorted(got(a.spmv(six), "y").items())] == want


def test_star_keeps_going_without_out_edges(spark):
    out = got(a.pagerank(graph(spark, [(0, k) for k in range(1, 5)], 5)), "rank")
    assert math.isclose(out[0], 0.03) and math.isclose(out[1], 0.03 + 0.85 * 0.03 / 4)


def test_negative_cycle(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, -3), (2, 0, 1)], 4)
    assert set(got(a.bellman_ford(g, 0), "dist").values()) == {-a.INFINITE}


def test_negative_cycle_query_reaches_all(spark, monkeypatch):
    path = [(k, k + 1, 1) for k in range(40)]
    asked = []
    whole = a.bellman_ford
    monkeypatch.setattr("loomgraph.queries.algorithms.bellman_ford", lambda g, source: asked.append(g.m) or whole(g, source))
    out = got(queries.bellman_ford_negative_cycle(graph(spark, path + [(d, s, w) for s, d, w in path], 41)), "dist")
    assert asked == [80] and out == {k: -a.INFINITE for k in range(41)}


def test_negative_weights_without_a_cycle(spark):
    edges = [(k, k + 1, -1) for k in range(12)] + [(12, 0, 12), (0, 5, 3), (3, 1, 2)]
    assert got(a.bellman_ford(graph(spark, edges, 14), 0), "dist") == {k: -k for k in range(13)}
    far = [(k, k + 1, 1) for k in range(6)] + [(6, 7, -5), (7, 5, 3)]
    assert set(got(a.bellman_ford(graph(spark, far, 9), 0), "dist").values()) == {-a.INFINITE}


def test_long_path(spark):
    g = graph(spark, [(k, k + 1) for k in range(30)], 31)
    assert got(a.bfs(g, 0), "level") == {k: k for k in range(31)}
    assert set(got(a.components(g), "label").values()) == {0}


def test_loops_and_parallel_edges_count(spark):
    g = graph(spark, [(0, 1), (0, 1), (1, 1)], 3)
    assert got(g.degrees(), "out_degree", "in_degree") == {0: (2, 0), 1: (1, 3), 2: (0, 0)}
    assert got(a.betweenness(g, 0), "sigma")[1] == 2.0


@pytest.mark.parametrize("logs", [False, True])
def test_beliefs(spark, logs):
    g = graph(spark, [(0, 1), (1, 0)], 2)
    v = spark.createDataFrame([(0, 0.6, 0.4), (1, 0.3, 0.7)], "id long, psi0 double, psi1 double")
    e = g.edges.select("src", "dst", "eid", F.lit(0.9).alias("psi00"), F.lit(0.1).alias("psi01"), F.lit(0.2).alias("psi10"), F.lit(0.8).alias("psi11"))
    state, psi = {0: (1.0, 1.0), 1: (1.0, 1.0)}, {0: (0.6, 0.4), 1: (0.3, 0.7)}
    for _ in range(3):
        state = {d: (psi[d][0] * 0.9 * p[0] + psi[d][1] * 0.1 * p[1], psi[d][0] * 0.2 * p[0] + psi[d][1] * 0.8 * p[1]) for d, p in state.items()}
    out = got(a.belief_propagation(g, v, e, rounds=3, logs=logs), "product0", "product1")
    for d, p in state.items():
        assert all(math.isclose(math.exp(x) if logs else x, y, rel_tol=1e-9) for x, y in zip(out[d], p))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng, n = random.Random(seed), 24
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 9)) for _ in range(50)]
    g = graph(spark, edges, n)
    dist = {0: 0}
    for _ in range(n):
        for s, d, w in edges:
            if s in dist and dist[s] + w < dist.get(d, 10**9):
                dist[d] = dist[s] + w
    assert got(a.bellman_ford(g, 0), "dist") == dist
    label = list(range(n))
    for _ in range(n):
        for s, d, _w in edges:
            label[d] = min(label[d], label[s])
    assert got(a.components(g), "label") == dict(enumerate(label))
    level, k = {0: 0}, 0
    while any(v == k for v in level.values()):
        for d in {d for s, d, _w in edges if level.get(s) == k and d not in level}:
            level[d] = k + 1
        k += 1
    assert got(a.bfs(g, 0), "level") == level
    delta = got(a.betweenness(g, 0), "delta")
    assert math.isclose(sum(x for x in delta.values() if x is not None), sum(level.values()))
