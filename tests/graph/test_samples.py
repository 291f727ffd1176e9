"""Golden values on a sample graph of 128 vertices, without and with weights, where files of it are at hand.

SAMPLE_GRAPHS names the two files, in this order, with a colon between them. The
values come from FIXTURES.md.
"""

import os
from collections import Counter

import pytest

from loomgraph.plans import algorithms as a
from loomgraph.plans.layout import indexed
from loomgraph.sources.files import read_graph

FILES = os.environ.get("SAMPLE_GRAPHS", "").split(os.pathsep)

pytestmark = pytest.mark.skipif(len(FILES) != 2, reason="SAMPLE_GRAPHS doesn't name two files")

#: source -> vertices by level, sums of least parents, of shortest paths and of dependencies, all in hops
HOPS = {0: ({0: 1, 1: 8, 2: 20, 3: 50, 4: 41, 5: 5}, 4938, 387, 387), 100: ({0: 1, 1: 2, 2: 5, 3: 18, 4: 51, 5: 43, 6: 5}, 5583, 351, 515)}
#: source -> sum and greatest of the finite distances, for each file
DISTANCES = {0: ((387, 5), (1291, 19)), 100: ((515, 6), (1155, 19))}
#: sum, and the greatest values by vertex
RANKS = (0.980078125, {51: 0.02135895, 116: 0.017293455, 110: 0.015748087})
DELTA_RANKS = (0.975885484, {51: 0.02115163, 116: 0.017159591, 110: 0.015599803})
PRODUCTS = ((5.53125, 0.1484375), (22.46875, 0.6640625))


@pytest.fixture(scope="module", params=[0, 1], ids=["plain", "weighted"])
def sample(spark, request):
    return request.param, read_graph(spark, FILES[request.param], symmetric=True).cached()


@pytest.mark.parametrize("source", [0, 100])
@pytest.mark.parametrize("by_index", [False, True])
def test_levels_and_paths(sample, source, by_index):
    g = indexed(sample[1]) if by_index else sample[1]
    levels, parents, sigma, delta = HOPS[source]
    rows = a.bfs(g, source).collect()
    assert len(rows) == 125 and Counter(r.level for r in rows) == levels and sum(r.parent for r in rows) == parents
    paths = [r for r in a.betweenness(g, source).collect() if r.level is not None]
    assert len(paths) == 125 and sum(r.sigma for r in paths) == sigma
    assert sum(r.delta for r in paths) == pytest.approx(delta) == sum(r.level for r in rows)
    radii = {r.id: r.radius for r in a.radii(g, g.vertices.filter(f"id = {source}")).collect()}
    assert {i: n for i, n in radii.items() if n >= 0} == {r.id: r.level for r in rows} and len(radii) == 128


@pytest.mark.parametrize("source", [0, 100])
def test_distances(sample, source):
    which, g = sample
    dist = [r.dist for r in a.bellman_ford(g, source, with_unreached=True).collect()]
    finite = [d for d in dist if d != a.INFINITE]
    assert len(dist) == 128 and len(finite) == 125 and (sum(finite), max(finite)) == DISTANCES[source][which]


@pytest.mark.parametrize("mode", ["propagate", "undirected"])
def test_components(sample, mode):
    labels = [r.label for r in a.components(sample[1], mode).collect()]
    assert sorted(Counter(labels).values()) == [1, 1, 1, 125] and sum(labels) == 46


@pytest.mark.parametrize(("program", "golden"), [(a.pagerank, RANKS), (a.pagerank_delta, DELTA_RANKS)])
def test_ranks(sample, program, golden):
    total, top = golden
    ranks = {r.id: r.rank for r in program(sample[1]).collect()}
    assert sum(ranks.values()) == pytest.approx(total, abs=1e-9)
    assert {i: ranks[i] for i in sorted(ranks, key=ranks.get)[-3:]} == pytest.approx(top, abs=1e-8)


def test_products(sample):
    which, g = sample
    y = {r.id: r.y for r in a.spmv(g).collect()}
    total, most = PRODUCTS[which]
    assert sum(y.values()) == pytest.approx(total) and max(y, key=y.get) == 51 and y[51] == pytest.approx(most)
