"""Graph files: each format is written here and read back."""

import numpy as np
import pytest

from loomgraph.graph import from_edges
from loomgraph.plans.run import main, run
from loomgraph.sources.files import read_csr, read_gr, read_graph, with_transpose_checked, write_adjacency_text

EDGES = [(0, 1, 3), (0, 2, 1), (2, 0, 5), (2, 2, 7), (2, 1, 2)]
N = 4


def edges_of(g, weights=True):
    return sorted((r.src, r.dst, r.w if weights else 1) for r in g.edges.collect())


def text(weighted):
    offsets = [0, 2, 2, 5]
    body = [N, len(EDGES), *offsets, *(d for _, d, _ in EDGES), *((w for *_, w in EDGES) if weighted else ())]
    return ("WeightedAdjacencyGraph" if weighted else "AdjacencyGraph") + "\n" + "\n".join(map(str, body)) + "\n"


@pytest.mark.parametrize("weighted", [False, True])
def test_text(spark, tmp_path, weighted):
    (tmp_path / "g").write_text(text(weighted).replace("\n", "\r\n\t ", 3))
    g = read_graph(spark, str(tmp_path / "g"))
    assert g.n == N and edges_of(g) == sorted((s, d, w if weighted else 1) for s, d, w in EDGES)
    assert sorted(r.eid for r in g.edges.collect()) == list(range(5))


def test_text_over_several_splits(spark, tmp_path):
    n = 500
    edges = [(v, (v * 7 + k) % n) for v in range(n) for k in range(3)]
    (tmp_path / "g").write_text("AdjacencyGraph\n" + "\n".join(map(str, [n, len(edges), *range(0, 3 * n, 3), *(d for _, d in edges)])) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        g = read_graph(spark, str(tmp_path / "g"))
        assert edges_of(g, False) == sorted((s, d, 1) for s, d in edges)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("bad", ["Graph\n1\n0\n0\n", "AdjacencyGraph\n2\n1\n0\n", ""])
def test_bad_text(spark, tmp_path, bad):
    (tmp_path / "g").write_text(bad)
    with pytest.raises(ValueError):
        read_graph(spark, str(tmp_path / "g"))


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("wide", [False, True])
def test_gr(spark, tmp_path, weighted, wide):
    size = np.int64 if wide else np.int32
    raw = np.array([1, 4 if weighted else 0, N, len(EDGES), 2, 2, 5, 5], size).tobytes() + np.array([d for _, d, _ in EDGES] + [0], np.uint32).tobytes()
    if weighted:
        raw += np.array([w for *_, w in EDGES], np.int32).tobytes()
    (tmp_path / "g.gr").write_bytes(raw)
    g = read_gr(spark, str(tmp_path / "g.gr"), wide=wide)
    assert g.n == N and edges_of(g) == sorted((s, d, w if weighted else 1) for s, d, w in EDGES)


def test_csr(spark, tmp_path):
    (tmp_path / "g.config").write_text(f"{N}\n")
    (tmp_path / "g.adj").write_bytes(np.array([d for _, d, _ in EDGES], np.uint32).tobytes())
    (tmp_path / "g.idx").write_bytes(np.array([0, 2, 2, 5], np.int64).tobytes())
    assert edges_of(read_csr(spark, str(tmp_path / "g")), False) == sorted((s, d, 1) for s, d, _ in EDGES)


@pytest.mark.parametrize("weighted", [False, True])
def test_round_trip_and_companion(spark, tmp_path, weighted):
    g = from_edges(spark.createDataFrame(EDGES, "src long, dst long, w long"), spark.range(N))
    write_adjacency_text(g, str(tmp_path / "out"), weighted)
    write_adjacency_text(g.transpose(), str(tmp_path / "out_t"), weighted)
    back = read_graph(spark, str(tmp_path / "out"))
    assert back.n == N and edges_of(back, weighted) == edges_of(g, weighted)
    with_transpose_checked(back, read_graph(spark, str(tmp_path / "out_t")))
    with pytest.raises(ValueError):
        with_transpose_checked(back, back)


def test_written_over_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loomgraph.sources.files.FILE_LINES", 300)
    monkeypatch.setattr("loomgraph.sources.files.STRETCH", 4)
    n = 200
    edges = [(v, (v * 7 + k) % n, k) for v in range(n) for k in range(3)] + [(5, d, 9) for d in range(0, n, 2)]
    g = from_edges(spark.createDataFrame(edges, "src long, dst long, w long"), spark.range(n))
    write_adjacency_text(g, str(tmp_path / "out"), True)
    assert len(list((tmp_path / "out").glob("part-*"))) > 3
    assert edges_of(read_graph(spark, str(tmp_path / "out"))) == sorted(edges)


def test_companion_is_found(spark, tmp_path):
    (tmp_path / "g").write_text(text(False))
    (tmp_path / "g_t").write_text("AdjacencyGraph\n4\n1\n0\n1\n1\n1\n2\n")
    with pytest.raises(ValueError, match="g_t"):
        read_graph(spark, str(tmp_path / "g"))
    assert read_graph(spark, str(tmp_path / "g"), symmetric=True).n == N


def test_run(spark, tmp_path):
    (tmp_path / "g").write_text(text(True))
    out, took = run(spark, "bfs", str(tmp_path / "g"), source=0, rounds=2, num_partitions=3, partition_by="source")
    assert len(took) == 2 and sorted((r.id, r.level) for r in out.collect()) == [(0, 0), (1, 1), (2, 1)]
    with pytest.raises(ValueError, match="vertex 100"):
        run(spark, "bfs", str(tmp_path / "g"))
    main(["spmv", str(tmp_path / "g"), str(tmp_path / "y"), "-rounds", "1", "-P", "dest"])
    assert spark.read.parquet(str(tmp_path / "y")).count() == N
