"""Partitions, placements, scans by any operation, folds of the caller's own, vertex functions, radii, and binary ranges."""

import os
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_programs import got, graph

from loomgraph.graph import from_edges
from loomgraph.operators import edge_map, partition, sequence
from loomgraph.operators.edge_map import Fold, fold_edges, vertex_apply
from loomgraph.plans import algorithms as a
from loomgraph.queries import _largest
from loomgraph.sources import numbers as nb
from loomgraph.sources.files import read_gr, write_adjacency_text


@pytest.fixture(scope="module")
def towns(spark):
    """Four groups of 50 vertices, dense inside, ids dealt so that runs and hashes cut them; a hub, and isolated vertices."""
    rng = random.Random(2)
    edges = []
    for _ in range(1500):
        x = rng.randrange(200)
        edges.append((x, (x + 4 * rng.randrange(1, 50)) % 200))  # the same remainder by four
    edges += [(rng.randrange(200), rng.randrange(200)) for _ in range(60)] + [(0, k) for k in range(1, 60)] + [(5, 5)]
    return graph(spark, edges, 210)


def test_approximate_parts(spark, towns):
    parts = partition.partition_approx(towns, 4, slack=0.2)
    own = got(parts, "part")
    assert set(own) == set(range(210)) and set(own.values()) <= set(range(4)) and parts.count() == 210
    sizes = [sum(v == p for v in own.values()) for p in range(4)]
    assert max(sizes) <= 63  # ceil(1.2 * 210 / 4)
    by_hash = towns.vertices.select("id", F.pmod(F.xxhash64("id"), F.lit(4)).alias("part"))
    (edges, cut), (_, cut_by_hash) = partition.cut_edges(towns, parts).first(), partition.cut_edges(towns, by_hash).first()
    assert edges == towns.m and cut < 0.5 * cut_by_hash
    assert got(partition.partition_approx(towns, 4, slack=0.2), "part") == own


def test_approximate_parts_keep_their_bound_without_room(spark, towns):
    own = got(partition.partition_approx(towns, 7, slack=0.0), "part")
    assert [sum(v == p for v in own.values()) for p in range(7)] == [30] * 7
    lone = graph(spark, [(0, 0)], 3)
    assert sorted(got(partition.partition_approx(lone, 3), "part").values()) == [0, 1, 2]


def test_parts_become_runs_of_ids(spark, towns):
    parts = partition.partition_approx(towns, 4, slack=0.2)
    mapping = got(partition.by_rank(parts).select(F.col("old").alias("id"), "new"), "new")
    own = got(parts, "part")
    order = sorted(mapping, key=mapping.get)
    assert sorted(mapping.values()) == list(range(210)) and [own[v] for v in order] == sorted(own.values())


def test_edges_lie_where_their_parts_say(spark, towns):
    degree, runs = partition.degree_parts(towns, 4), partition.vertex_parts(towns, 3)
    lies = partition.by_parts(towns, degree, 4).edges.withColumn("p", F.spark_partition_id()).join(degree.withColumnRenamed("id", "dst"), "dst")
    assert lies.count() == towns.m and lies.filter("p <> part").isEmpty()
    blocks = partition.by_parts(towns, runs, 12, "src", degree, 4).edges.withColumn("p", F.spark_partition_id())
    told = blocks.join(runs.select(F.col("id").alias("src"), F.col("part").alias("i")), "src").join(degree.select(F.col("id").alias("dst"), F.col("part").alias("j")), "dst")
    assert told.count() == towns.m and told.filter("p <> i * 4 + j").isEmpty()
    grid = partition.two_d(towns, 8).edges.select(F.spark_partition_id().alias("p"), partition.block_of(8).alias("b"))
    assert grid.filter("p <> b").isEmpty() and grid.select("p").distinct().count() == 8
    with pytest.raises(ValueError):
        partition.two_d(towns, 7)
    with pytest.raises(Exception, match="out of range"):
        partition.by_parts(towns, degree.withColumn("part", F.col("part") + 1), 4).edges.count()


def brute_radii(edges, sources, n):
    far = dict.fromkeys(range(n), -1)
    for s in sources:
        level, front, k = {s: 0}, {s}, 0
        while front:
            k += 1
            front = {d for x, d in edges if x in front and d not in level}
            level |= dict.fromkeys(front, k)
        for v, k in level.items():
            far[v] = max(far[v], k)
    return far


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_radii(spark, monkeypatch, most):
    rng = random.Random(most)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(130)]
    g = graph(spark, edges, 90)
    sources = list(range(0, 78, 2)) + list(range(1, 50, 2))
    assert len(sources) == 64  # the sign bit is in use
    monkeypatch.setattr(edge_map, "MOST_PUSHED", most)
    assert got(a.radii(g, spark.createDataFrame([(s,) for s in sources], "id long")), "radius") == brute_radii(edges, sources, 90)
    if most > 3:
        assert set(got(a.radii(g, g.vertices.limit(0)), "radius").values()) == {-1}
        assert a.radii(g).count() == 90
        with pytest.raises(ValueError):
            a.radii(g, g.vertices)


@pytest.mark.parametrize("n", [0, 1, 3, 200])
@pytest.mark.parametrize("back", [False, True])
def test_scan_by_any_operation(spark, monkeypatch, n, back):
    monkeypatch.setattr(sequence, "FOLDED", 4)  # four levels of blocks
    rng = random.Random(n)
    rows = [(k * 3 - 50, f"{k}." if rng.random() < 0.9 else None) for k in range(n)]
    df = spark.createDataFrame(rows[::-1], "k long, s string").repartition(3)
    # Joining strings is associative and doesn't commute.
    for inclusive in (False, True):
        out = got(sequence.scan_with(df.withColumnRenamed("k", "id"), "id", F.col("s"), lambda x, y: F.concat(x, y), inclusive, back), "scan")
        along, want = "", {}
        for k, s in rows[::-1] if back else rows:
            if inclusive:
                along += s or ""
            want[k] = along or None
            if not inclusive:
                along += s or ""
        assert out == want


def test_scan_of_structs(spark):
    rows = spark.range(1000).select("id", F.struct((F.col("id") % 7 + 1).alias("a"), (F.col("id") % 5).alias("b")).alias("m"))
    after = lambda f, g: F.struct(((f["a"] * g["a"]) % 101).alias("a"), ((g["a"] * f["b"] + g["b"]) % 101).alias("b"))
    out = sequence.scan_with(rows, "id", F.col("m"), after, inclusive=True)
    assert out.columns == ["id", "m", "scan"]
    x, y = 1, 0
    for r in out.orderBy("id").collect():
        x, y = x * (r.id % 7 + 1) % 101, ((r.id % 7 + 1) * y + r.id % 5) % 101
        assert (r.scan.a % 101, r.scan.b % 101) == (x, y)


@pytest.mark.parametrize("held", [5, 200_000])
def test_folds_of_the_callers_own(spark, towns, monkeypatch, held):
    monkeypatch.setattr(edge_map, "MOST_FOLDED", held)
    state = towns.vertices.withColumn("x", F.col("id") % 13)
    out = got(fold_edges(towns, state, F.col("s_x") + F.col("w"), _largest(3)), "value")
    want = {}
    for r in towns.edges.collect():
        want.setdefault(r.dst, set()).add(r.src % 13 + r.w)
    assert out == {d: ",".join(map(str, sorted(v, reverse=True)[:3])) for d, v in want.items()}
    few = fold_edges(towns, state, F.col("s_x"), _largest(1), towns.vertices.filter("id = 0"))
    assert set(got(few, "value").values()) == {"0"}
    assert fold_edges(towns, state, F.col("s_x"), _largest(1), towns.vertices.limit(0)).count() == 0


def test_a_fold_moves_one_state_for_each_task_and_destination(spark):
    star = graph(spark, [(k, k % 2) for k in range(4000)], 4000)
    seen = spark.sparkContext.accumulator(0)

    def counted(pdf):
        seen.add(len(pdf))
        return pdf.groupby("dst")["n"].sum().reset_index()

    fold = Fold(lambda p: p.groupby("dst").size().reset_index(name="n"), counted, lambda p: pd.DataFrame({"dst": p["dst"], "value": p["n"]}), "n long", "value long")
    out = got(fold_edges(star, star.vertices, F.lit(1), fold), "value")
    assert out == {0: 2000, 1: 2000}
    assert seen.value <= 2 * 2 * 4 * star.edges.rdd.getNumPartitions() + 8  # states, not edges


def test_a_fold_of_many_destinations_merges_a_row_few_times(spark):
    """Batches are small beside what a task holds: it must not merge all it holds for each of them."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        g = graph(spark, [(k, k % 1500) for k in range(3000)], 3000)
        g = from_edges(g.edges.coalesce(1), g.vertices)
        seen, largest = spark.sparkContext.accumulator(0), _largest(2)

        def merge(pdf):
            seen.add(len(pdf))
            return largest.merge(pdf)

        out = got(fold_edges(g, g.vertices.withColumn("x", F.col("id") - 7), F.col("s_x"), replace(largest, merge=merge)), "value")
        assert out == {d: f"{d + 1493},{d - 7}" for d in range(1500)}
        assert seen.value <= 4 * 3000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("rows, held", [(1, 1), (7, 3), (50, 200_000)])
def test_folds_in_pieces(spark, towns, monkeypatch, rows, held):
    """Messages of any sign and size, among them the ends of the longs, whatever the size of the pieces."""
    monkeypatch.setattr(edge_map, "FOLD_ROWS", rows)
    monkeypatch.setattr(edge_map, "MOST_FOLDED", held)
    ends = {0: -(2**63), 1: 2**63 - 1, 2: -1, 3: 2**53 + 1}
    state = towns.vertices.select("id", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ends.items() for x in p]).cast("map<long,long>"), F.col("id") % 11), F.col("id") % 5).alias("x"))
    want = {}
    for r in towns.edges.collect():
        want.setdefault(r.dst, set()).add(ends.get(r.src % 11, r.src % 5))
    out = got(fold_edges(towns, state, F.col("s_x"), _largest(3)), "value")
    assert out == {d: ",".join(map(str, sorted(v, reverse=True)[:3])) for d, v in want.items()}


def test_vertex_functions(spark):
    state = spark.createDataFrame([(1, 2.0, "a"), (2, None, None), (3, 4.0, "c")], "id long, x double, s string")

    def fn(pdf):
        assert len(pdf)
        return pd.DataFrame({"id": pdf["id"], "y": pdf["x"].fillna(-1) * 2, "s": pdf["s"]})

    assert got(vertex_apply(state, fn, "id long, y double, s string"), "y", "s") == {1: (4.0, "a"), 2: (-2.0, None), 3: (8.0, "c")}
    assert got(vertex_apply(state, fn, "id long, y double, s string", spark.range(3, 4)), "y") == {3: 8.0}
    assert vertex_apply(state.limit(0), fn, "id long, y double, s string").count() == 0
    assert vertex_apply(state, lambda pdf: pdf.iloc[:0][["id"]], "id long").count() == 0


def test_binary_ranges_beyond_two_gigabytes(spark, tmp_path, monkeypatch):
    """A sparse file: what was never written reads as zeros and takes no room."""
    path, m = str(tmp_path / "g.gr"), 600_000_001
    with open(path, "wb") as f:
        f.write(np.array([1, 0, 2, m, m - 1, m], np.int64).tobytes())
        f.seek(48 + 4 * (m - 2))
        f.write(np.array([1, 7, 0], np.uint32).tobytes())
    assert os.path.getsize(path) > 2_400_000_000
    tail = nb.numbers(spark, path, "<u4", 3, 48 + 4 * (m - 3))
    assert sorted(tuple(r) for r in tail.collect()) == [(0, 0), (1, 1), (2, 7)]
    whole = nb.numbers(spark, path, "<u4", m, 48)
    assert whole.rdd.getNumPartitions() == -(-4 * m // nb.RANGE_BYTES)
    monkeypatch.setattr(nb, "RANGE_BYTES", 1024)
    part = nb.numbers(spark, path, "<u4", 5000, 48 + 4 * (m - 5000))
    rows = part.select("at", "value", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == 5000 and len({r.p for r in rows}) == 20 and {r.at: r.value for r in rows if r.value} == {4998: 1, 4999: 7}
    with pytest.raises(Exception, match="ends before"):
        nb.numbers(spark, path, "<u4", 10, 48 + 4 * (m - 5)).collect()


def test_binary_graph_in_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nb, "RANGE_BYTES", 64)
    n, rng = 60, np.random.default_rng(3)
    degree = rng.integers(0, 9, n)
    m = int(degree.sum())
    to, w = rng.integers(0, n, m), rng.integers(1, 99, m)
    raw = np.concatenate([[1, 4, n, m], np.cumsum(degree)]).astype(np.int64).tobytes() + np.concatenate([to, [0] * (m % 2)]).astype(np.uint32).tobytes() + w.astype(np.int32).tobytes()
    (tmp_path / "g").write_bytes(raw)
    g = read_gr(spark, str(tmp_path / "g"))
    assert sorted((r.src, r.eid, r.dst, r.w) for r in g.edges.collect()) == sorted(zip(np.repeat(np.arange(n), degree).tolist(), range(m), to.tolist(), w.tolist()))
    (tmp_path / "short").write_bytes(raw[:-1])
    with pytest.raises(ValueError, match="bytes"):
        read_gr(spark, str(tmp_path / "short"))
    (tmp_path / "none").write_bytes(np.array([1, 0, 0, 0], np.int64).tobytes())
    assert read_gr(spark, str(tmp_path / "none")).edges.count() == 0


def test_a_hub_is_ranked_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loomgraph.sources.files.RANKED", 50)
    rng = random.Random(5)
    edges = [(0, k % 180, k) for k in range(400)] + [(rng.randrange(200), rng.randrange(200), 1) for _ in range(100)]
    g = graph(spark, edges, 200)
    write_adjacency_text(g, str(tmp_path / "out"), True)
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().split()]
    n, m = 200, len(edges)
    offsets, targets, weights = (list(map(int, x)) for x in (lines[3 : 3 + n], lines[3 + n : 3 + n + m], lines[3 + n + m :]))
    ends = [*offsets[1:], m]
    for v in range(n):
        assert list(zip(targets[offsets[v] : ends[v]], weights[offsets[v] : ends[v]])) == sorted((d, w) for s, d, w in edges if s == v)
