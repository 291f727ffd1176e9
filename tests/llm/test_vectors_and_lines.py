"""Clustering, whitening and line dedup against brute force, and the cases that must not crash."""

import hashlib
import math
import random
import string
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import ODD, docs_of

from loomgraph.llm import line_dedup, whiten as whitening
from loomgraph.llm.cluster import Annulus, cluster_vectors, clusters
from loomgraph.llm.line_dedup import dedup_lines
from loomgraph.llm.whiten import whiten

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, cluster string, dim string, component string, n string"


def vectors_of(spark, rows):
    """rows (vec_id, vector); the other columns clash with names the operators use."""
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "a", "b", "c", "d", "e", "f") for i, v in rows], VECTORS).repartition(3)


def odd_vectors(dim=64):
    one = [0.5] * dim
    return [(1, None), (2, []), (3, [None] + one[1:]), (4, [math.nan] + one[1:]), (5, [math.inf] + one[1:]), (None, one), (6, one), (6, one), (7, [0.0] * dim), (8, [-x for x in one])]


@pytest.fixture(scope="module")
def some_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 64)) * 0.2
    rows = [(i, (base[i % 6] + rng.normal(size=64) * (0.02 + 0.1 * (i % 3))).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a common vector
    return [*rows, *odd_vectors(), (9, [0.1] * 63), (10, [0.1] * 65)]


def lloyd(rows, k=8, rounds=10):
    """Plain Python over whole numbers."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        x = np.array([v for _, v in kept], dtype=np.int64)
        d = ((x[:, None] - np.array(c)[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        near, _ = assign()
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, near) if a == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    near, d = assign()
    return sorted((i if i is not None else -1, int(a), int(b)) for (i, _), a, b in zip(kept, near, d)), c


def test_clusters_against_brute_force(spark, some_vectors):
    out = clusters(vectors_of(spark, some_vectors)).collect()
    want, c = lloyd(some_vectors)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in out) == want
    by = defaultdict(int)
    for _, a, d in want:
        by[a] += d
    for r in out:
        assert r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_clusters_of_few_and_none(spark):
    out = clusters(vectors_of(spark, odd_vectors())).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id) for r in out) == [-1, 6, 6, 7, 8]
    assert {r.distance for r in out} == {0} and len({r.cluster for r in out if r.vec_id in (None, 6)}) == 1
    none = clusters(vectors_of(spark, odd_vectors()).limit(0))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
    assert clusters(vectors_of(spark, odd_vectors()[:5])).count() == 0
    with pytest.raises(Exception, match="exact"):
        clusters(vectors_of(spark, [(1, [1e30] * 64)])).collect()
    with pytest.raises(ValueError):
        cluster_vectors(vectors_of(spark, odd_vectors()), k=10**7)


@pytest.mark.parametrize("k", [1, 2, 7, 300])
def test_annulus_is_exact_and_prunes(k):
    rng = np.random.default_rng(k)
    # Few distinct values, so that ties and vectors on the boundary are common; norms differ much, so that there is something to prune.
    c = (rng.integers(-3, 4, size=(k, 8)) * rng.choice([1, 5, 60], size=(k, 1))).astype(np.int64)
    x = np.concatenate([(rng.integers(-3, 4, size=(3000, 8)) * rng.choice([1, 5, 60], size=(3000, 1))).astype(np.int64), c, np.zeros((1, 8), np.int64)])
    search = Annulus(c)
    number, best = search.nearest(x)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (number == d.argmin(1)).all() and (best == d.min(1)).all()
    if k == 300:
        assert search.compared < 0.7 * k * len(x)
    assert [len(a) for a in search.nearest(x[:0])] == [0, 0]


def test_annulus_keeps_ties_on_the_boundary():
    # The vector is as far from each, and both norms lie on the edges of its annulus.
    c = np.array([[9, 0], [3, 0]], dtype=np.int64)
    assert Annulus(c).nearest(np.array([[6, 0]]))[0].tolist() == [0]
    assert Annulus(c[::-1].copy()).nearest(np.array([[6, 0]]))[0].tolist() == [0]


def whitened_brute(rows, dim, components=32):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], dtype=np.int64)
    s, n = x.sum(0), len(x)
    z = (n * x - s) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return [i for i, _ in kept], n, [sum(int(v) ** 2 for v in r) for r in n * x - s], z @ u / np.sqrt(e), e / np.trace(z.T @ z / n)


@pytest.mark.parametrize("tile", [32, 8])
def test_whitening_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(whitening, "TILE", tile)
    monkeypatch.setattr(whitening, "ROW_BLOCK", 50)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(2)
    scale = np.linspace(0.2, 3, 64)
    rows = [(i, (rng.normal(size=64) * scale).astype(np.float32).tolist()) for i in range(500)]
    rows = [*rows, *rows[:40], *odd_vectors()[:5], (70, [1.0] * 63), (None, rows[5][1])]
    out = whiten(vectors_of(spark, rows)).collect()
    ids, n, deviation, w, share = whitened_brute(rows, 64)
    assert len(out) == n * 32 and {r.n for r in out} == {n} and {r.component for r in out} == set(range(1, 33))
    got = defaultdict(list)
    for r in out:
        assert abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
        got[r.vec_id, r.component].append((r.deviation, r.whitened))
    sign = {k: np.sign(got[3, k][0][1] * w[ids.index(3), k - 1]) for k in range(1, 33)}
    for row, i in enumerate(ids):
        for k in (1, 2, 31, 32):
            for d, x in got[i, k]:
                assert d == deviation[row] and abs(x - sign[k] * w[row, k - 1]) < 1e-8


def test_whitening_of_few_and_none(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    none = whiten(vectors_of(spark, odd_vectors()).limit(0))
    assert none.columns == columns and none.count() == 0 and whiten(vectors_of(spark, odd_vectors()[:5])).count() == 0
    alike = whiten(vectors_of(spark, [(1, [0.5] * 4), (2, [0.5] * 4), (3, [9.0])])).collect()
    assert len(alike) == 8 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in alike)
    few = whiten(vectors_of(spark, odd_vectors(40))).collect()  # two directions at most
    assert len(few) == 5 * 32 and {r.component for r in few if r.whitened is not None} == {1}
    assert all(r.identity_error < 1e-9 for r in few)


def test_deviation_beyond_63_bits():
    x, s = np.array([[3, -4]]), np.array([1, 2])
    n = 10**10
    assert whitening._deviation(x, s, n) == [(3 * n - 1) ** 2 + (-4 * n - 2) ** 2]


def lines_brute(rows, min_chars=10, min_docs=2):
    key = lambda x: "".join(c.lower() if c in string.ascii_uppercase else c for c in x.strip(" \t\n\x0b\f\r"))
    held = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add((i is None, i or 0))
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < min_docs or min(held[key(x)]) == (i is None, i or 0)]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


LINES = ["a shared line here", "  A Shared LINE here\t", "\x0ba shared line here\r", "short", "Ähnliche Zeile Ä", "ähnliche Zeile ä", "nine char", " not a blank at the end ", "not a blank at the end", "ten chars!", "\U0001f600" * 10, ""]


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup_against_brute_force(spark, monkeypatch, apart, min_docs):
    if apart:  # no broadcast, and common keys set apart
        monkeypatch.setattr(line_dedup, "HEAVY", 5)
        monkeypatch.setattr(line_dedup, "HEAVY_SHARE", 50)
        monkeypatch.setattr(line_dedup, "is_small", lambda df: False)
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice([*LINES, f"line of its own {i}", f"some line {rng.randrange(60)}"]) for _ in range(rng.randrange(0, 12))), "s") for i in range(-5, 120)]
    rows += [*ODD, ODD[0], rows[0], (3, "a shared line here\nmore lines of three", "s"), (None, "a shared line here\nonly without an id", "s"), (None, "only without an id", "s")]
    out = dedup_lines(docs_of(spark, rows), min_docs=min_docs)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect())
    assert got == lines_brute(rows, min_docs=min_docs)
    assert out.columns == [*docs_of(spark, ODD).columns, "n_lines", "n_dropped"]
    assert out.filter("text is null").count() == 2


def test_line_dedup_of_long_texts_and_none(spark):
    long = "\n".join(f"line number {k % 50_000}" for k in range(100_000))
    rows = [(1, "line number 7", "s"), (2, long, "s"), (3, long, "s")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs_of(spark, rows)).collect()}
    assert got[2] == (100_000, 2, "\n".join(x for x in long.split("\n") if x != "line number 7")) and got[3] == (100_000, 100_000, "")
    assert dedup_lines(docs_of(spark, ODD).limit(0)).count() == 0
    assert dedup_lines(docs_of(spark, rows).withColumn("n_lines", F.lit("x"))).columns.count("n_lines") == 1
    with pytest.raises(ValueError):
        dedup_lines(docs_of(spark, ODD), min_docs=1)
