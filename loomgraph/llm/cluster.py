"""Centroid clustering in whole numbers, with an annulus search for the nearest centroid."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .vectors import finite_rows, floored, is_finite

#: Components are floor(SCALE * x); vectors have DIM of them.
SCALE, DIM = 1024, 64
#: Centroids, rounds, and the seed of the first centroids' hashes.
K, ROUNDS, SEED = 8, 10, 3
#: Bytes of the centroids that every task holds, and rows compared at once.
MOST_BYTES, STRETCH = 256 << 20, 4096


class Annulus:
    """The nearest of the centroids c (k, dim) by squared distance in whole numbers; ties go to the smaller number.

    Centroids are sorted by norm. A vector's distance to any centroid bounds
    that to the nearest one; by the triangle inequality the norm of a nearer
    one, or of one as near, differs from the vector's by no more than the bound.
    Those are found by two binary searches, and compared exactly.
    """

    def __init__(self, c: np.ndarray):
        self.c = c
        norm = np.sqrt((c.astype(np.float64) ** 2).sum(1))
        self.order = np.lexsort((np.arange(len(c)), norm))
        self.norm = norm[self.order]
        # Some centroids over all norms, about the root of their number, of which the nearest gives the bound.
        self.pivots = np.unique(np.linspace(0, len(c) - 1, 1 + int(np.sqrt(len(c))), dtype=np.int64))
        #: Comparisons made so far, and vectors they were made for.
        self.compared = self.asked = 0

    def _distance(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        self.compared += len(x)
        d = x - self.c[self.order[place]]
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) for each row of whole numbers."""
        parts = [self._nearest(x[a : a + STRETCH]) for a in range(0, len(x), STRETCH)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.asked += len(x)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        last = len(self.c) - 1
        right = np.minimum(np.searchsorted(self.norm, norm), last)
        left = np.maximum(right - 1, 0)
        near = np.where(np.abs(self.norm[left] - norm) <= np.abs(self.norm[right] - norm), left, right)
        bound = self._distance(x, near)
        for p in self.pivots:
            bound = np.minimum(bound, self._distance(x, np.full(len(x), p)))
        radius = np.sqrt(bound.astype(np.float64))
        radius += 1e-6 + 1e-12 * (norm + radius)  # norms are rounded: what lies on the boundary must be inside
        lo, hi = np.searchsorted(self.norm, norm - radius, "left"), np.searchsorted(self.norm, norm + radius, "right")
        best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.c))
        for step in range(int((hi - lo).max(initial=0))):
            rows = np.flatnonzero(lo + step < hi)
            place = lo[rows] + step
            d, own = self._distance(x[rows], place), self.order[place]
            better = (d < best[rows]) | ((d == best[rows]) & (own < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], own[better]
        return number, best


def _most(dim: int) -> int:
    """The largest component: dim squared differences of twice as much fit into 63 bits."""
    return int(np.sqrt(2**62 / max(dim, 1))) // 2


def _sums(c: np.ndarray, scale: int):
    """Vectors -> (cluster, n, sums) once for each cluster of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = c.shape
        search, n, sums = Annulus(c), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x = floored(finite_rows(batch.column(0), dim)[1], scale, _most(dim))
            number, _ = search.nearest(x)
            n += np.bincount(number, minlength=k)
            np.add.at(sums, number, x)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(c: np.ndarray, scale: int):
    """(id, vector) -> (id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(c)
        for batch in batches:
            at, x = finite_rows(batch.column(1), c.shape[1])
            number, distance = search.nearest(floored(x, scale, _most(c.shape[1])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int, scale: int, dim: int, seed: int) -> np.ndarray:
    """The vectors whose 'seed:id' has the smallest hashes, in that order; equal ids go by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.filter(is_finite("v", dim)).select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return floored(np.array([r.v for r in first], dtype=np.float64).reshape(-1, dim), scale, _most(dim))


def centroids_of(rows: DataFrame, k: int, rounds: int, scale: int, dim: int, seed: int) -> np.ndarray:
    """Centroids (k, dim) after the rounds; fewer if there are fewer vectors."""
    c = first_centroids(rows, k, scale, dim, seed)
    for _ in range(rounds if len(c) else 0):
        parts = rows.select("v").mapInArrow(_sums(c, scale), "cluster long, n long, sums array<long>")
        # Partial sums, a row for each cluster and task, are added by component.
        by_part = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "part")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
        new = c.copy()
        for r in by_part.collect():  # k * dim rows
            new[r.cluster, r.dim] = r.total // r.n
        if (new == c).all():
            break  # further rounds would change nothing
        c = new
    return c


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: int = SEED, ident: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows (id, cluster, distance) of the kept vectors, centroids), by Lloyd's rounds in whole numbers.

    Vectors with exactly dim components, none null or non-finite, are kept;
    a component x becomes floor(scale * x). The first centroids are the vectors
    with the smallest hashes of their id. A round assigns every vector to the
    nearest centroid, the one with the smaller number on a tie, and replaces
    each centroid that has vectors by the floors of their means; sums are exact,
    so neither the order of rows nor a lost executor changes anything. Tasks
    search by Annulus and hand on one row of sums for each cluster; the driver
    holds k centroids and nothing else, and every round reads the vectors anew.

    Fewer than k vectors make fewer centroids; an empty table gives no row. Rows
    with equal ids, or none, are rows of their own; a null id hashes as empty,
    and among equal ids the lesser vector comes first. Equal vectors fall into
    one cluster. Columns other than the id and the vector are ignored, whatever
    their names. A component so large that squared distances could leave 63
    bits is an error.
    """
    if k < 1 or k * dim * 8 > MOST_BYTES:
        raise ValueError(f"{k} centroids of {dim} components: every task holds them, {MOST_BYTES} bytes at most")
    rows = vectors.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    c = centroids_of(rows, k, rounds, scale, dim, seed)
    kind = rows.schema["id"].dataType.simpleString()
    if not len(c):
        return rows.limit(0).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c
    return settle(rows.mapInArrow(_assigned(c, scale), f"id {kind}, cluster int, distance long")), c


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of cluster_vectors, with its options and its treatment of odd rows.

    Inertia sums squared distances, over the vector's cluster and over all;
    centroid_sha256 is the digest of the centroid's components as decimal
    numbers joined by commas.
    """
    assigned, c = cluster_vectors(vectors, **options)
    ident = options.get("ident", "vec_id")
    inertia = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    told = [(j, inertia[j], sum(inertia.values()), sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in sorted(inertia)]
    of_cluster = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select(F.col("id").alias(ident), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
