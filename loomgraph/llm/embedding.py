"""Embedding near-dedup over a robust-pruned flat graph that is built on overlapping shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop_settled, join_unique, settle
from .fitting import chosen
from .ngram_join import _groups

COSINE = 0.98
#: Vectors a medoid stands for, medoids at most, and bounds of the sample they come from: vectors, and bytes.
PER_MEDOID, MOST_MEDOIDS, MOST_SAMPLED, MOST_BYTES = 350, 4096, 40_000, 32 << 20
#: Shards a vector lies in, vectors of a block, out-degree, candidates of a node, slack of the pruning, beam.
OVERLAP, BLOCK, DEGREE, CANDIDATES, ALPHA, BEAM = 3, 2048, 20, 64, 1.2, 16
#: How far below the threshold a node may lie for a walk to go on from it.
SLACK = 0.01
#: The neighbours of every vector whose id this divides are counted exactly; the recall below which the search is widened.
AUDITED, LEAST_RECALL = 100, 0.97


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very small and very large vectors survive."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def medoids_of(x: np.ndarray, k: int, rounds: int = 6, seed: int = 13) -> np.ndarray:
    """k rows of x (unit vectors) that lie nearest to the means of k spherical clusters."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        mean = np.zeros_like(c)
        np.add.at(mean, near, x)
        norm = np.linalg.norm(mean, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, mean / np.maximum(norm, 1e-12), c)
    return x[np.unique((x @ c.T).argmax(0))]


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Out-neighbours (n, degree) of each row, -1 where there are fewer.

    The nearest candidate is taken again and again; each one taken rules out
    the candidates that are alpha times nearer to it than to the node.
    """
    n = len(x)
    out = np.full((n, degree), -1, dtype=np.int64)
    if n < 2:
        return out
    s = (x @ x.T).astype(np.float32)
    np.fill_diagonal(s, -2)
    m = min(candidates, n - 1)
    cand = np.argpartition(-s, m - 1, axis=1)[:, :m]
    dist = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, cand, 1)))
    free, rows = np.ones((n, m), dtype=bool), np.arange(n)
    for k in range(min(degree, m)):
        at = np.where(free, dist, np.inf).argmin(1)
        live = free[rows, at]
        if not live.any():
            break
        chosen = cand[rows, at]
        out[live, k] = chosen[live]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.where(chosen[:, None] == cand, 1, s[chosen[:, None], cand])))
        free &= ~((alpha * between <= dist) & live[:, None])
        free[rows, at] = False
    return out


def thinned(c: np.ndarray, least: float) -> np.ndarray:
    """The medoids less those in range of one taken before, so that a group of vectors in range of each other isn't dealt over many shards."""
    kept = np.zeros(len(c), dtype=bool)
    for i in range(len(c)):
        kept[i] = not (c[kept] @ c[i] >= least).any()
    return c[kept]


def range_search(x: np.ndarray, lists: list[np.ndarray], entries: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """Matrix (query, row) of the pairs with cosine >= least that greedy walks over the lists come to, in either direction.

    Walks begin at the entries and at the query's own node and go on from the
    best nodes seen until the beam holds nothing new; then every node in range
    is expanded until the range is exhausted. A query with so many nodes in
    range that their lists outnumber the rows is compared with all rows.
    """
    n = len(x)
    width = max(1, max((len(a) for a in lists), default=1))
    adj = np.full((n, width), n, dtype=np.int64)
    for i, a in enumerate(lists):
        adj[i, : len(a)] = a
    x32 = x.astype(np.float32)
    slack = least - SLACK
    seen = np.zeros((n, n + 1), dtype=bool)
    seen[:, n] = True
    hit = np.zeros((n, n), dtype=bool)
    at, sim, fresh = np.full((n, beam), n), np.full((n, beam), -2, dtype=np.float32), np.zeros((n, beam), dtype=bool)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []  # in range, not expanded

    def visit(q: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that are new, with their cosines; those in range are noted."""
        new = ~seen[q, to]
        key = np.unique(q[new] * (n + 1) + to[new])
        q, to = key // (n + 1), key % (n + 1)
        seen[q, to] = True
        s = np.concatenate([np.einsum("ij,ij->i", x32[q[a : a + 100_000]], x32[to[a : a + 100_000]]) for a in range(0, max(1, len(q)), 100_000)])
        near = s >= slack
        waiting.append((q[near], to[near]))
        close = np.flatnonzero(s >= least - 1e-4)
        for a in range(0, len(close), 100_000):
            k = close[a : a + 100_000]
            hit[q[k], to[k]] = np.einsum("ij,ij->i", x[q[k]], x[to[k]]) >= least
        return q, to, s

    def merge(q: np.ndarray, to: np.ndarray, s: np.ndarray) -> None:
        """Keep the best of the beam and what was visited."""
        some = s > sim[q, -1]
        q, to, s = q[some], to[some], s[some]
        rows = np.unique(q)
        if not len(rows):
            return
        k = len(rows)
        all_q = np.concatenate([np.repeat(np.arange(k), beam), np.searchsorted(rows, q)])
        all_to, all_s = np.concatenate([at[rows].ravel(), to]), np.concatenate([sim[rows].ravel(), s])
        all_f = np.concatenate([fresh[rows].ravel(), np.ones(len(q), dtype=bool)])
        order = np.lexsort((-all_s, all_q))
        first = np.searchsorted(all_q[order], np.arange(k))
        best = order[first[:, None] + np.arange(beam)]
        at[rows], sim[rows], fresh[rows] = all_to[best], all_s[best], all_f[best]

    all_rows = np.arange(n)
    merge(*visit(np.concatenate([np.repeat(all_rows, len(entries)), all_rows]), np.concatenate([np.tile(entries, n), all_rows])))
    for _ in range(4 * beam):
        best = np.argsort(~fresh, axis=1, kind="stable")[:, :4]
        q, k = np.nonzero(np.take_along_axis(fresh, best, 1))
        if not len(q):
            break
        k = best[q, k]
        nodes = at[q, k]
        fresh[q, k] = False
        merge(*visit(np.repeat(q, width), adj[nodes].ravel()))
    done = np.zeros((n, n), dtype=bool)
    while waiting:
        q, nodes = (np.concatenate(c) for c in zip(*waiting))
        waiting.clear()
        new = ~done[q, nodes]
        q, nodes = q[new], nodes[new]
        crowded = np.flatnonzero(np.bincount(q, minlength=n) * width > n)
        if len(crowded):
            for a in range(0, len(crowded), 256):
                c = crowded[a : a + 256]
                hit[c] = x[c] @ x.T >= least
            seen[crowded] = done[crowded] = True
            free = ~np.isin(q, crowded)
            q, nodes = q[free], nodes[free]
        done[q, nodes] = True
        for a in range(0, len(q), 20_000):
            visit(np.repeat(q[a : a + 20_000], width), adj[nodes[a : a + 20_000]].ravel())
        if waiting and not any(len(c[0]) for c in waiting):
            break
    hit |= hit.T.copy()
    np.fill_diagonal(hit, False)
    return hit


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _assign(medoids: dict, overlap: int):
    """node, grp, v -> a row for each of the shards whose medoids are nearest; all of them are named in each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for grp, g in pdf.groupby("grp"):
                base, c = medoids.get(grp, (-1, None))
                for a in range(0, len(g), 2000):
                    part = g.iloc[a : a + 2000]
                    if c is None:  # no vector of the group is in the sample: one shard for it
                        yield pd.DataFrame({"node": part["node"], "grp": grp, "shard": -1, "shards": [[-1]] * len(part), "v": part["v"]})
                        continue
                    k = min(overlap, len(c))
                    near = np.argpartition(-(_unit(_matrix(part["v"])) @ c.T), k - 1, axis=1)[:, :k] + base
                    for j in range(k):
                        yield pd.DataFrame({"node": part["node"].to_numpy(), "grp": grp, "shard": near[:, j], "shards": list(near), "v": part["v"].to_numpy()})

    return run


def _build(least: float):
    """The lists of each block, with the shard they were made in; close: neighbours in range, wide: those of which something in range of the node's own neighbours can be."""
    near_by = float(np.clip(least - SLACK, -1, 1))
    reach = np.arccos(near_by) + np.arccos(np.clip(least, -1, 1))
    within = np.cos(min(np.pi, reach)) - 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["grp", "shard", "block"]):
            g = g.sort_values("node")
            node = g["node"].to_numpy()
            x = _unit(_matrix(g["v"]))
            out = robust_prune(x)
            back: list[list[int]] = [[] for _ in range(len(g))]
            for i, row in enumerate(out):
                for j in row[row >= 0]:
                    if len(back[j]) < DEGREE:
                        back[j].append(i)
            lists = [np.unique(np.concatenate([r[r >= 0], np.array(b, dtype=np.int64)])) for r, b in zip(out, back)]
            cosines = [x[a] @ x[i] for i, a in enumerate(lists)]
            near, close, wide = ([node[a[c >= bound]] for a, c in zip(lists, cosines)] for bound in (-2, near_by, within))
            mean = x.mean(0)
            medoid = int((x @ mean).argmax())
            many = pa.list_(pa.int64())
            arrays = [pa.array(node), pa.array(g["shard"].to_numpy()), pa.array(near, many), pa.array(close, many), pa.array(wide, many), pa.array(np.arange(len(g)) == medoid)]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "shard", "near", "close", "wide", "medoid"])

    return run


def _least_linked(hit: np.ndarray) -> np.ndarray:
    """The least index each row is linked with, over any number of links of a symmetric matrix."""
    root, free = np.arange(len(hit)), hit.any(1)
    for i in np.flatnonzero(free):
        front = np.array([i]) if free[i] else np.zeros(0, dtype=np.int64)
        free[i] = False
        while len(front):
            root[front] = i
            front = np.flatnonzero(hit[front].any(0) & free)
            free[front] = False
    return root


def _counted_here(g: pd.DataFrame, q: np.ndarray, to: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """Whether a pair counts in this task: it does in the least shard and, there, in the first pair of blocks that hold both."""
    shard, i, j = (int(g[k].iloc[0]) for k in ("shard", "i", "j"))
    block = g["block"].to_numpy()
    here = (block[q] != block[to]) | (i == j) | ((i == 0) & ((block[q] == j) | (j == 1)))
    for column in shards.T:
        below = column[q] < shard
        here &= ~(below & (shards[to] == column[q][:, None]).any(1))
    return here


def _search(least: float, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["grp", "shard", "i", "j"]):
            g = g.sort_values("node")
            node, copies, audited = g["node"].to_numpy(), g["copies"].to_numpy(), g["audited"].to_numpy()
            index = {int(v): i for i, v in enumerate(node)}
            lists = [np.array([index[v] for v in a if v in index], dtype=np.int64) for a in g["near"]]
            entries = np.flatnonzero(g["medoid"].to_numpy())
            hit = range_search(_unit(_matrix(g["v"])), lists, entries if len(entries) else np.array([0]), least, beam)
            shards = np.stack(g["shards"].to_numpy())
            links, hits = np.zeros(len(g), dtype=np.int64), [np.zeros(0, dtype=np.int64)] * len(g)
            root = _least_linked(hit)
            for a in range(0, len(g), 64):
                q, to = np.nonzero(hit[a : a + 64])
                here = _counted_here(g, q + a, to, shards)
                q, to = q[here] + a, to[here]
                np.add.at(links, q, copies[to])
                for k in np.flatnonzero(audited[a : a + 64]) + a:
                    hits[k] = node[to[q == k]]
            some = hit.any(1)
            if some.any():
                arrays = [pa.array(node[some]), pa.array(links[some]), pa.array([h for h, s in zip(hits, some) if s], pa.list_(pa.int64())), pa.array(node[root[some]])]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "links", "hits", "root"])

    return run


def _links(nodes: DataFrame, least: float, overlap: int | None, beam: int) -> DataFrame:
    """Rows (node, links, hits, root) of the search, once for each shard pair of blocks, and of the walks that leave their shards.

    links counts rows, each pair of nodes in one of the tasks that find it; hits
    names the nodes, for those that are audited. Without an overlap each group
    is one shard, and no walk leaves it.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = nodes.count()
    medoids = _medoids(nodes, n, least) if overlap else {}
    shards = settle(nodes.select("node", "grp", "v").mapInPandas(_assign(medoids, overlap or 1), "node long, grp string, shard long, shards array<long>, v array<double>"))
    sizes = shards.groupBy("grp", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    shards = shards.join(sizes, ["grp", "shard"]).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))
    shards = settle(shards)
    tasks = max(parts, shards.count() // BLOCK)
    built = shards.select("grp", "shard", "block", "node", "v").repartition(tasks, "grp", "shard", "block").sortWithinPartitions("grp", "shard", "block")
    built = built.mapInArrow(_build(least), "node long, shard long, near array<long>, close array<long>, wide array<long>, medoid boolean")

    def united(name: str) -> Column:
        return F.array_distinct(F.flatten(F.collect_list(name))).alias(name)

    graph = built.groupBy("node").agg(united("near"), united("close"), F.collect_list(F.struct("shard", "wide")).alias("doors"), F.max("medoid").alias("medoid"))
    graph = settle(graph.join(nodes.select("node", "copies", "audited"), "node"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("block"))))
    pairs = shards.join(graph.drop("close", "doors"), "node").withColumn("other", other)
    pairs = pairs.select("grp", "shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "shards", "node", "v", "near", "medoid", "copies", "audited")
    inside = settle(pairs.repartition(tasks, "grp", "shard", "i", "j").sortWithinPartitions("grp", "shard", "i", "j").mapInArrow(_search(least, beam), "node long, links long, hits array<long>, root long"))
    if not medoids:
        return inside
    across = _across(graph, shards, least)
    return inside if across is None else settle(inside.unionByName(across))


def _verify(least: float):
    """a, b, va, vb -> the pairs in range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 2000):
                part = pdf.iloc[k : k + 2000]
                near = np.einsum("ij,ij->i", _unit(_matrix(part["va"])), _unit(_matrix(part["vb"]))) >= least
                yield part.loc[near, ["a", "b"]]

    return run


def _across(graph: DataFrame, shards: DataFrame, least: float) -> DataFrame | None:
    """Rows (node, links, hits, root), one for each way of each pair in range that has no shard in common; None where no such pair is found.

    Walks go on where their shards end: from a node over its neighbours in range
    to the lists these have in other shards, then on from whatever was found in
    range, until a round finds nothing new. List entries that are too far from
    the neighbour to be in range of the node (by the angles) are left out, so
    nodes without neighbours in range cost nothing. A node is named in the lists
    of its own few blocks only, so no key of these joins is hot. Candidates are
    compared by their vectors.
    """
    at = shards.filter(F.col("shard") == F.col("shards")[0]).select("node", "shards", "v")
    place = at.select("node", "shards")
    lists = graph.select(F.col("node").alias("via"), F.explode("doors").alias("door")).select("via", F.col("door.shard").alias("shard"), F.col("door.wide").alias("wide")).filter(F.size("wide") > 0)
    asked = graph.select("node", F.explode("close").alias("via"))
    found: list[DataFrame] = []
    while True:
        to = asked.join(place, "node").join(lists, "via").filter(~F.array_contains("shards", F.col("shard"))).select("node", F.explode("wide").alias("to"))
        pairs = to.filter(F.col("to") != F.col("node")).select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()
        for known in found:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        ends = (place.select(F.col("node").alias(k), F.col("shards").alias(f"s{k}")) for k in "ab")
        pairs = pairs.join(next(ends), "a").join(next(ends), "b").filter(~F.arrays_overlap("sa", "sb")).select("a", "b")
        whole = (at.select(F.col("node").alias(k), F.col("v").alias(f"v{k}")) for k in "ab")
        new = settle(pairs.join(next(whole), "a").join(next(whole), "b").mapInPandas(_verify(least), "a long, b long"))
        if new.isEmpty():
            drop_settled(new)
            break
        found.append(new)
        asked = _both_ways(new).select("node", F.col("root").alias("via"))
    if not found:
        return None
    every = _both_ways(reduce(DataFrame.unionByName, found))
    every = every.join(graph.select(F.col("node").alias("root"), F.col("copies").alias("links")), "root").join(graph.select("node", "audited"), "node")
    return every.select("node", "links", F.when(F.col("audited"), F.array("root")).otherwise(F.array().cast("array<long>")).alias("hits"), "root")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("root")))


def _medoids(nodes: DataFrame, n: int, least: float) -> dict:
    """grp -> (number of its first shard, medoids), from a hashed sample that is bounded in vectors and in bytes."""
    widest = nodes.agg(F.max(F.size("v"))).first()[0] or 1
    most = min(MOST_SAMPLED, max(1, MOST_BYTES // (8 * widest)))
    sample = nodes.filter(chosen(F.xxhash64(F.lit(3), "node"), most, n)).select("node", "grp", "v").toPandas().sort_values(["grp", "node"])
    medoids, base = {}, 0
    for grp, g in sample.groupby("grp"):
        k = max(1, min(round(n * len(g) / max(len(sample), 1) / PER_MEDOID), max(1, MOST_MEDOIDS * len(g) // len(sample))))
        c = thinned(medoids_of(_unit(_matrix(g["v"])), k), least)
        medoids[grp] = (base, c)
        base += len(c)
    return medoids


def audit_recall(nodes: DataFrame, links: DataFrame, least: float) -> float | None:
    """The share of the links of the audited nodes, counted by brute force, that the search found; None where they have none.

    The queries are compared with all nodes in blocks of bounded bytes, one block after the other.
    """
    found = links.select("node", F.explode("hits").alias("hit")).distinct()
    n, widest = nodes.filter("audited").agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = -(-n * 8 * (widest or 1) // MOST_BYTES)
    total = right = 0
    for k in range(blocks):
        queries = nodes.filter(F.col("audited") & (F.pmod(F.xxhash64(F.lit(9), "node"), F.lit(blocks)) == k)).select("node", "grp", "v").toPandas()
        by_grp = {grp: (g["node"].to_numpy(), _unit(_matrix(g["v"]))) for grp, g in queries.groupby("grp")}

        def brute(batches: Iterator[pd.DataFrame], by_grp=by_grp) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for grp, g in pdf.groupby("grp"):
                    if grp in by_grp:
                        ids, x = by_grp[grp]
                        own = g["node"].to_numpy()
                        for a in range(0, len(g), 2000):
                            q, to = np.nonzero((x @ _unit(_matrix(g["v"].iloc[a : a + 2000])).T >= least) & (ids[:, None] != own[None, a : a + 2000]))
                            yield pd.DataFrame({"node": ids[q], "hit": own[to + a]})

        truth = settle(nodes.select("node", "grp", "v").mapInPandas(brute, "node long, hit long"))
        total += truth.count()
        right += truth.join(found, ["node", "hit"], "left_semi").count()
        drop_settled(truth)
    return right / total if total else None


def near_vectors(vectors: DataFrame, least: float = COSINE, overlap: int = OVERLAP, beam: int = BEAM) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept, recall), one for each row of vectors.

    Vectors of one label and length are compared by cosine in double precision.
    Equal vectors are one node, so a common vector costs nothing. Nodes go to
    the shards of their nearest medoids, a robust-pruned graph is built on each
    shard, adjacency lists are united over shards, and every node is searched
    for from the medoids. Larger shards are cut into blocks that are searched
    two by two, so no task holds more than two blocks. Walks then go on over the
    united lists into the shards a node doesn't lie in. No two medoids are in
    range of each other, so vectors in range of each other meet in few shards.
    The recall of every vector whose id is divisible by AUDITED, or whose hash
    is where no such vector can be compared, is measured by brute force, and
    null where those have no links to find; below LEAST_RECALL the search is repeated, wider, and at last
    with each group as one shard, whose blocks all meet. If that falls short
    too, it is an error. Only pairs at the threshold are linked.

    Vectors that are null, zero or empty, that hold null or non-finite parts,
    and those with a null label link with nothing and are kept. n_links counts
    rows, copies included; rows with the same vec_id, or none, are rows of their
    own. An empty table gives no row; other columns are ignored.
    """
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", F.monotonically_increasing_id().alias("rid"), "label", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.select("vec_id", "rid", F.coalesce(good, F.lit(False)).alias("good"), F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string")).alias("grp"), F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    # Equal vectors meet by two digests, not by their parts.
    rows = settle(rows.withColumns({"d1": F.xxhash64("grp", "v"), "d2": F.xxhash64(F.lit(1), F.reverse("v"), F.col("grp"))}))
    asked = F.coalesce(F.max(F.pmod(F.col("vec_id").cast("long"), F.lit(AUDITED)) == 0), F.lit(False))
    nodes = settle(rows.filter("good").groupBy("grp", "d1", "d2").agg(F.min("rid").alias("node"), F.min("vec_id").alias("low"), F.count("*").alias("copies"), asked.alias("audited"), F.min("v").alias("v")))
    if nodes.filter("audited").isEmpty():
        nodes = nodes.withColumn("audited", F.pmod(F.xxhash64(F.lit(11), "d1", "d2"), F.lit(AUDITED)) == 0)
    for times in (1, 2, 4, None):
        links = _links(nodes, least, times and overlap * times, beam * (times or 8))
        recall = audit_recall(nodes, links, least)
        if recall is None or recall >= LEAST_RECALL:
            break
        drop_settled(links)
    else:
        raise RuntimeError(f"the search found {recall:.3f} of the audited links, less than {LEAST_RECALL}")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = nodes.select("d1", "d2", "node", "low", "copies").join(counts, "node", "left").join(parts, "node", "left").filter("copies > 1 or links > 0")
    told = settle(told.withColumn("label", F.coalesce("label", "node")))
    names = told.groupBy("label").agg(F.min("low").alias("component_id"))
    told = settle(join_unique(told, names, ["label"]).select("d1", "d2", "copies", "links", "component_id"))
    out = join_unique(rows.filter("good").select("vec_id", "d1", "d2"), told, ["d1", "d2"], "left").drop("d1", "d2")
    bad = rows.filter("not good").select("vec_id", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("long").alias("links"), F.col("vec_id").alias("component_id"))
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    component = F.coalesce("component_id", "vec_id")
    return out.unionByName(bad).select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("recall"))
