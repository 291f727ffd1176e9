"""Scans, hashes, curve keys and partitioners against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph import queries
from loomgraph.functions.scalar import hash_long, hash_unsigned, hilbert_key, reciprocal, round_up_pow2
from loomgraph.graph import from_edges
from loomgraph.operators import partition, sequence
from loomgraph.operators.edge_map import EdgeFn, edge_map, edge_map_counted, everything, vertex_filter

M64 = (1 << 64) - 1


def hash64(a):
    consts = (0x7ED55D166BEF7A1D, 0xC761C23C510FA2DD, 0x165667B183A9C0E1, 0xD3A2646CAB3487E3, 0xFD7046C5EF9AB54C, 0xB55A4F090DD4A67B)
    for c, op in zip(consts, (lambda a, c: a + c + (a << 12), lambda a, c: a ^ c ^ (a >> 9), lambda a, c: a + c + (a << 59), lambda a, c: (a + c) ^ (a << 49), lambda a, c: a + c + (a << 3), lambda a, c: a ^ c ^ (a >> 32))):
        a = op(a, c) & M64
    return a - (1 << 64) if a >> 63 else a


def test_hashes(spark):
    values = [0, 1, 2, 12345678901, 2**62 + 17, -1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "a long").select(hash_long(F.col("a")), hash_unsigned(F.col("a")))
    rows = df.collect()
    assert [r[0] for r in rows] == [hash64(v & M64) for v in values]
    assert all(0 <= r[1] < 2**32 for r in rows) and len({r[1] for r in rows}) > 4


def test_powers_and_reciprocals(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 1023, 1024, 1025)], "a long")
    assert [r[0] for r in df.select(round_up_pow2(F.col("a"))).collect()] == [1, 2, 4, 4, 8, 1024, 1024, 2048]
    assert spark.range(2).select(reciprocal(F.col("id"))).collect()[0][0] is None


def test_hilbert_neighbours_touch(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    rows = sorted(df.select(hilbert_key(F.col("x"), F.col("y"), 3).alias("h"), "x", "y").collect())
    assert [r.h for r in rows] == list(range(64)) and (rows[0].x, rows[0].y) == (0, 0)
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))


def test_hilbert_queries_tell_large_ids_apart(spark, monkeypatch):
    edges = spark.createDataFrame([(5, 9, 1), (5 + 2**20, 9, 1), (5, 9 + 2**29, 1)], "src long, dst long, w long")
    g = from_edges(edges)
    monkeypatch.setattr("loomgraph.queries.derived.part_supplier", lambda *_: g)
    small = g.edges.filter("src + dst < 20").select(hilbert_key(F.col("src"), F.col("dst"), 20)).first()[0]
    for rows in (queries.hilbert_key_query(g).collect(), queries.QUERIES["hilbert_order"](spark, "").collect()):
        keys = {(r.src, r.dst): r.h for r in rows}
        assert len(set(keys.values())) == 3 and keys[5, 9] == small
    with pytest.raises(Exception, match="outside the square"):
        edges.select(hilbert_key(F.col("src"), F.col("dst"), 20)).collect()


def test_scans(spark):
    rng = random.Random(3)
    x = [rng.randrange(-50, 50) for _ in range(700)]
    df = spark.createDataFrame([(3 * i, v) for i, v in enumerate(x)], "i long, v long")
    read = lambda d: [r.scan for r in d.orderBy("i").collect()]
    assert read(sequence.plus_scan(df, "i", "v")) == [sum(x[:i]) for i in range(700)]
    assert read(sequence.scan_back(df, "i", "v")) == [sum(x[i + 1 :]) for i in range(700)]
    assert read(sequence.scan_inclusive_back(df, "i", "v")) == [min(x[i:]) for i in range(700)]
    assert read(sequence.scan(df, "i", "v", "max")) == [None, *(max(x[:i]) for i in range(1, 700))]
    assert sequence.plus_scan(df.limit(0), "i", "v").count() == 0


def test_partitions_keep_every_edge(spark):
    rng = random.Random(4)
    g = from_edges(spark.createDataFrame([(rng.randrange(40), min(39, int(rng.expovariate(0.1)))) for _ in range(300)], "src long, dst long"), spark.range(40))
    for parts in (partition.degree_parts(g, 4), partition.vertex_parts(g, 4), partition.degree_parts(g, 3, out=True)):
        sizes = partition.part_sizes(g, parts).collect()
        assert sum(r.edges for r in sizes) == 300 and sum(r.vertices for r in sizes) == 40
    for dealt in (partition.by_source(g, 3), partition.by_destination(g, 3), partition.two_d(g, 4)):
        assert dealt.edges.exceptAll(g.edges).isEmpty() and g.edges.exceptAll(dealt.edges).isEmpty()
    assert g.transpose().transpose().edges.exceptAll(g.edges).isEmpty()
    assert partition.subgraph(g, spark.range(10)).edges.filter("src >= 10 or dst >= 10").isEmpty()
    mapping = spark.range(40).select(F.col("id").alias("old"), (39 - F.col("id")).alias("new"))
    assert partition.relabel(partition.relabel(g, mapping), mapping).edges.select("src", "dst").exceptAll(g.edges.select("src", "dst")).isEmpty()


def test_edge_map_and_vertex_filter(spark):
    g = from_edges(spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 2)], "src long, dst long"), spark.range(4))
    state = g.vertices.withColumn("x", F.col("id") + 10)
    out = {r.id: r.value for r in edge_map(g, state, EdgeFn(F.col("s_x") * F.col("w")), everything(g)).collect()}
    assert out == {1: 10, 2: 33}
    new, kept = vertex_filter(state, F.col("x") > 21, x=F.col("x") * 2)
    assert sorted(r.x for r in new.collect()) == [20, 22, 24, 26] and sorted(r.id for r in kept.collect()) == [1, 2, 3]


def test_plans_push_and_prune(spark, tmp_path):
    spark.createDataFrame([(0, 1, 5, 9)], "src long, dst long, w long, extra long").write.parquet(str(tmp_path / "e"))
    g = from_edges(spark.read.parquet(str(tmp_path / "e")))
    plan = edge_map(g, g.vertices, EdgeFn(F.col("src"), "min", needs_source=False))._jdf.queryExecution().executedPlan().toString()
    assert "extra" not in plan and "ReadSchema: struct<src:bigint,dst:bigint>" in plan


def test_counted_edge_map_and_own_order(spark):
    g = from_edges(spark.createDataFrame([(0, k % 7 + 1) for k in range(60)] + [(9, 1)], "src long, dst long"), spark.range(10))
    few, stats = edge_map_counted(g, g.vertices, EdgeFn(F.lit(1), "count", needs_source=False), spark.range(9, 10))
    assert (stats.size, stats.out_edges, stats.pushed) == (1, 1, True) and [tuple(r)[:2] for r in few.collect()] == [(1, 1)]
    many, stats = edge_map_counted(g, g.vertices, EdgeFn(F.lit(1), "count", needs_source=False), spark.range(1))
    assert (stats.size, stats.out_edges, stats.pushed) == (1, 60, False) and many.count() == 7
    assert not queries._in_order(g.edges.select("src", "dst").coalesce(1).orderBy(F.desc("dst")), "dst").filter("not sorted").isEmpty()


def test_scan_of_clustered_order(spark, monkeypatch):
    monkeypatch.setattr(sequence, "BLOCK_ROWS", 50)
    ids = sorted({*range(400), 10**15, *range(10**17, 10**17 + 300)})
    values = [(i * 31) % 17 - 5 for i in range(len(ids))]
    df = spark.createDataFrame(list(zip(ids, values)), "id long, x long")
    got = [r.scan for r in sequence.plus_scan(df, "id", "x").orderBy("id").collect()]
    assert got == [sum(values[:k]) for k in range(len(ids))]
    got = [r.scan for r in sequence.scan_inclusive_back(df, "id", "x").orderBy("id").collect()]
    assert got == [min(values[k:]) for k in range(len(ids))]


def test_fold_of_the_callers_own(spark):
    g = from_edges(spark.createDataFrame([(0, 2, 3), (1, 2, 5), (2, 0, 7)], "src long, dst long, w long"))
    out = edge_map(g, g.vertices, EdgeFn(F.struct("src", "w"), lambda m: F.sum(m["w"] * m["src"]) + F.max(m["w"]), needs_source=False))
    assert {r.id: r.value for r in out.collect()} == {2: 10, 0: 21}
