"""N-gram Jaccard self-join of documents: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_settled, is_small, join_unique, settle
from .decontam import text_key
from .packed import Packed, chunks, mixed

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Rows of a band; bands follow from the threshold and the recall wanted.
BAND_ROWS = 5
#: Documents and n-grams of a block of a cluster, documents of a tile of it, and of a bucket that is looked into.
BLOCK, BLOCK_GRAMS, TILE, BUCKET = 4096, 1 << 20, 512, 512
#: Blocks a smaller cluster is spread over, and documents of such a block at least.
SPREAD, LEAST_BLOCK = 8, 256
#: Columns of the incidence matrix held at once, and rows a task of sketches aims at.
COLUMNS, TASK_ROWS = 4096, 100_000


def bands_for(threshold: float, recall: float, rows: int = BAND_ROWS) -> int:
    """The least number of bands of `rows` rows that find a pair at the threshold with probability `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(threshold**rows, 1 - 1e-12))))


def shingles(p: Packed, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct n-grams of words, sorted; a shorter text is one n-gram, one without words none."""
    h, owner = p.word_hashes(), p.text_of(p.w0)
    count = np.bincount(owner, minlength=len(p.lens))
    if not len(h):
        return owner, h
    salt = mixed(np.arange(1, n_words + 1, dtype=np.uint64)) | np.uint64(1)
    runs = max(0, len(h) - n_words + 1)
    whole = np.zeros(runs, dtype=np.uint64)
    for j in range(n_words):
        whole += h[j : j + runs] * salt[j]
    keep = owner[:runs] == owner[n_words - 1 :][:runs]
    out_owner, out = owner[:runs][keep], mixed(whole[keep])
    short = np.flatnonzero((count > 0) & (count < n_words))
    if len(short):
        first = np.searchsorted(owner, short)
        total = np.zeros(len(short), dtype=np.uint64)
        for j in range(n_words - 1):
            has = count[short] > j
            total[has] += h[first[has] + j] * salt[j]
        out_owner, out = np.concatenate([out_owner, short]), np.concatenate([out, mixed(total + count[short].astype(np.uint64))])
    order = np.lexsort((out, out_owner))
    out_owner, out = out_owner[order], out[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (out_owner[1:] != out_owner[:-1])
    return out_owner[new], out[new]


def _sketch(n_words: int, n_bands: int):
    """rid, t1, t2, text -> rid, t1, t2, n, k1, k2 (digest of the set), bands, sketch (16 bits of each minimum)."""
    hashes = n_bands * BAND_ROWS
    rng = np.random.default_rng(11)
    mult = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in chunks(batch.column(3).to_pylist()):
                owner, h = shingles(Packed(texts), n_words)
                m = len(texts)
                n = np.bincount(owner, minlength=m)
                full = np.flatnonzero(n)
                cut = np.searchsorted(owner, full)
                low = np.zeros((m, hashes), dtype=np.uint64)
                k = np.zeros((2, m), dtype=np.uint64)
                if len(full):
                    for i in range(hashes):
                        low[full, i] = np.minimum.reduceat(h * mult[i] + add[i], cut)
                    k[0, full] = np.add.reduceat(mixed(h), cut)
                    k[1, full] = np.add.reduceat(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), cut)
                band = np.zeros((m, n_bands), dtype=np.uint64)
                for r in range(BAND_ROWS):
                    band = mixed(band ^ low[:, r::BAND_ROWS])
                bands = pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * n_bands, band.view(np.int64).ravel())
                marks = [x.tobytes() for x in (low >> np.uint64(40)).astype(np.uint16)]
                part = [batch.column(c).slice(first, last - first) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*part, pa.array(n.astype(np.int64)), pa.array(k[0].view(np.int64)), pa.array(k[1].view(np.int64)), bands, pa.array(marks, pa.binary())], ["rid", "t1", "t2", "n", "k1", "k2", "bands", "sketch"])

    return run


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index each of n indexes is linked with, over any number of links."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys, from input sorted by them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        if held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            yield pd.concat(held)
            held = []
        change = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            x = pdf[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cut = [0, *np.flatnonzero(change).tolist(), len(pdf)]
        for a, b in zip(cut[:-1], cut[1:]):
            held.append(pdf.iloc[a:b])
            if b < len(pdf):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held)


def _look(least: float):
    """Buckets -> edges (a, b) from each node to the least one its sketch is near to, over links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in _groups(batches, ["band", "h"]):
            node = g["node"].to_numpy()
            marks = np.frombuffer(b"".join(g["sketch"]), dtype=np.uint16).reshape(len(g), -1)
            left, right = [], []
            for i in range(len(g) - 1):
                near = np.flatnonzero((marks[i + 1 :] == marks[i]).mean(1) >= least) + i + 1
                left.append(np.full(len(near), i))
                right.append(near)
            order = np.argsort(node)
            rank = np.empty(len(g), dtype=np.int64)
            rank[order] = np.arange(len(g))
            root = _roots(len(g), rank[np.concatenate(left)], rank[np.concatenate(right)]) if left else np.arange(len(g))
            moved = np.flatnonzero(root != np.arange(len(g)))
            a.extend(node[order[moved]].tolist())
            b.extend(node[order[root[moved]]].tolist())
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _cut(owner: np.ndarray, gram: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The (owner, gram) pairs of the owners from lo to hi - 1, owners counted from lo; owner is sorted."""
    a, b = np.searchsorted(owner, [lo, hi])
    return owner[a:b] - lo, gram[a:b]


def linked_tiles(sets: list[np.ndarray], first: int, threshold: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(r, c, matrix) of the tiles that hold links; matrix[i, j]: whether sets r + i and c + j have Jaccard >= threshold.

    first sets are compared with all others after them; all with each other if
    it is 0. Both parts must be sorted by size, so that tiles whose sizes are
    too far apart are passed over. Intersections are products of incidence
    matrices over the n-grams both tiles have.
    """
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    owner, gram = owner[shared], (np.cumsum(count > 1) - 1)[gram[shared]]
    place = np.full(int((count > 1).sum()), -1, dtype=np.int64)
    end = first or len(sets)
    for r in range(0, end, TILE):
        r1 = min(r + TILE, end)
        rows, its = _cut(owner, gram, r, r1)
        own = np.unique(its)
        place[own] = np.arange(len(own))
        for c in range(first or r, len(sets), TILE):
            c1 = min(c + TILE, len(sets))
            if n[c] * threshold > n[r1 - 1] + 1e-6 or n[r] * threshold > n[c1 - 1] + 1e-6:
                continue
            cols, theirs = _cut(owner, gram, c, c1)
            at = place[theirs]
            cols, at = cols[at >= 0], at[at >= 0]
            both = np.zeros((r1 - r, c1 - c), dtype=np.float32)
            used = np.zeros(len(own), dtype=bool)
            used[at] = True
            narrow = np.cumsum(used) - 1
            mine = place[its]
            mine_rows, mine = rows[used[mine]], narrow[mine[used[mine]]]
            at = narrow[at]
            for k in range(0, int(used.sum()), COLUMNS):
                x, y = np.zeros((r1 - r, COLUMNS), dtype=np.float32), np.zeros((c1 - c, COLUMNS), dtype=np.float32)
                here = (mine >= k) & (mine < k + COLUMNS)
                x[mine_rows[here], mine[here] - k] = 1
                here = (at >= k) & (at < k + COLUMNS)
                y[cols[here], at[here] - k] = 1
                both += x @ y.T
            linked = both >= threshold * (n[r:r1, None] + n[None, c:c1] - both) - 1e-6
            if r == c:
                np.fill_diagonal(linked, False)
            if linked.any():
                yield r, c, linked
        place[own] = -1


def _verify(threshold: float):
    """Block pairs -> (node, links, class_links, root): what each node is linked with inside the pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["cluster", "i", "j"]):
            one = g["i"].iloc[0] == g["j"].iloc[0]
            g = g.sort_values(["block", "n", "node"])
            node, copies = g["node"].to_numpy(), g["copies"].to_numpy()
            first = 0 if one else int((g["block"] == g["i"].iloc[0]).sum())
            if len(g) < 2 or not one and first in (0, len(g)):
                continue
            links, class_links = np.zeros(len(g), dtype=np.int64), np.zeros(len(g), dtype=np.int64)
            order = np.argsort(node)  # the least node leads
            rank = np.empty(len(g), dtype=np.int64)
            rank[order] = np.arange(len(g))
            left, right = [], []
            for r, c, linked in linked_tiles([np.asarray(s) for s in g["grams"]], first, threshold):
                rows, cols = np.arange(r, r + linked.shape[0]), np.arange(c, c + linked.shape[1])
                links[rows] += linked @ copies[cols]
                class_links[rows] += linked.sum(1)
                if r != c:
                    links[cols] += linked.T @ copies[rows]
                    class_links[cols] += linked.sum(0)
                nodes = np.unique(np.concatenate([rows, cols]))
                i, j = np.nonzero(linked)
                root = _roots(len(nodes), np.searchsorted(nodes, rows[i]), np.searchsorted(nodes, cols[j]))
                left.append(nodes)
                right.append(nodes[root])
            if left:
                root = node[order[_roots(len(g), rank[np.concatenate(left)], rank[np.concatenate(right)])[rank]]]
                some = class_links > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (node, links, class_links, root)], ["node", "links", "class_links", "root"])

    return run


def _grams(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in chunks(batch.column(2).to_pylist()):
                owner, h = shingles(Packed(texts), n_words)
                cut = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                part = [batch.column(c).slice(first, last - first) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*part, pa.ListArray.from_arrays(cut, h.view(np.int64))], ["t1", "t2", "grams"])

    return run


def _judged(docs: DataFrame, threshold: float, n_words: int, recall: float) -> DataFrame:
    """(doc_id, t1, t2, class_id, n_links, n_class_links, component_id, kept, linked) of every row; linked: whether another row has a copy or near copy of it."""
    n_bands = bands_for(threshold, recall)
    key = text_key()
    # A digest of the set, its bands and its sketch, once for each row of docs.
    read = docs.select(F.monotonically_increasing_id().alias("rid"), *key, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    made = read.select(F.struct("rid", "doc_id").alias("rid"), "t1", "t2", "text").mapInArrow(_sketch(n_words, n_bands), f"rid struct<rid:bigint,doc_id:{kind.simpleString()}>, t1 long, t2 int, n long, k1 long, k2 long, bands array<long>, sketch binary")
    rows = settle(made.select("rid.rid", "rid.doc_id", "t1", "t2", "n", "k1", "k2", "bands", "sketch"))
    full = rows.filter("n > 0")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("lead")
    classes = settle(full.groupBy("k1", "k2", "n").agg(F.min("rid").alias("node"), lead, F.count("*").alias("copies")))
    nodes = rows.select("rid", "t1", "t2", "bands", "sketch").join(classes.select("node", "n", "copies"), F.col("rid") == F.col("node")).drop("rid")
    nodes = settle(nodes)

    bands = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    buckets = settle(bands.groupBy("band", "h").agg(F.count("*").alias("size"), F.min("node").alias("low")).filter("size > 1"))
    members = join_unique(bands, buckets, ["band", "h"])  # a common band's nodes don't meet in one task
    inside = members.filter(F.col("size") <= BUCKET).select("node", "band", "h").join(nodes.select("node", "sketch"), "node")
    # A pair at the threshold falls five deviations below it once in millions.
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / (n_bands * BAND_ROWS))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meeting = buckets.filter(F.col("size") <= BUCKET).agg(F.sum("size")).first()[0] or 0
    edges = inside.repartition(max(parts, meeting // TASK_ROWS), "band", "h").sortWithinPartitions("band", "h").mapInArrow(_look(least), "a long, b long")
    edges = edges.unionByName(members.filter((F.col("size") > BUCKET) & (F.col("node") != F.col("low"))).select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct()
    clusters = components(edges)

    of_node = clusters.join(nodes.select("node", "t1", "t2", "n", "copies"), "node")
    size = settle(of_node.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS), F.least(F.ceil(F.count("*") / LEAST_BLOCK), F.lit(SPREAD))).cast("int").alias("blocks"), F.sum("n").alias("grams")))
    placed = join_unique(of_node, size.select("label", "blocks"), ["label"])
    placed = settle(placed.select("node", "t1", "t2", "n", "copies", F.col("label").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    texts = join_unique(docs.select(*key, "text"), placed.select("t1", "t2").distinct(), ["t1", "t2"]).groupBy("t1", "t2").agg(F.min("text").alias("text"))
    grams = texts.mapInArrow(_grams(n_words), "t1 long, t2 int, grams array<long>")
    with_sets = placed.join(grams, ["t1", "t2"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = with_sets.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "copies", "grams")
    shuffled = size.agg(F.sum(F.col("grams") * F.col("blocks"))).first()[0] or 0
    tasks = max(parts, shuffled // (2 * BLOCK_GRAMS))
    checked = settle(pairs.repartition(tasks, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_verify(threshold), "node long, links long, class_links long, root long"))

    links = checked.groupBy("node").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"), F.min("root").alias("root"))
    roots = links.select("node", "root")
    if not size.filter("blocks > 1").isEmpty():
        roots = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", F.col("label").alias("root"))
    of_class = classes.join(links.drop("root"), "node", "left").join(roots, "node", "left").filter("copies > 1 or class_links > 0")
    of_class = settle(of_class.select("k1", "k2", "n", "lead", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_links", F.lit(0)).alias("class_links"), F.coalesce("root", "node").alias("root")))
    told = join_unique(of_class, of_class.groupBy("root").agg(F.min("lead").alias("first")), ["root"]).drop("root")
    # Only rows with links meet their class; texts without words, which may be many, don't.
    out = settle(join_unique(full.select("doc_id", "t1", "t2", "k1", "k2", "n"), settle(told), ["k1", "k2", "n"], "left").drop("k1", "k2"))
    alone = rows.filter("n = 0").select("doc_id", "t1", "t2")
    drop_settled(nodes, buckets, size, placed, checked, of_class, classes)
    linked = F.coalesce(F.col("copies") > 0, F.lit(False))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    named = lambda c: F.when(linked, F.coalesce(F.col(f"{c}.doc_id"), F.col("doc_id"))).otherwise(F.col("doc_id"))
    none = F.lit(0).cast("long")
    told = out.select(
        "doc_id", "t1", "t2", named("lead").alias("class_id"), F.coalesce(F.col("copies") - 1 + F.col("links"), none).cast("long").alias("n_links"), F.coalesce(F.col("class_links"), none).alias("n_class_links"),
        named("first").alias("component_id"), F.when(linked, own.eqNullSafe(F.col("first"))).otherwise(F.lit(True)).alias("kept"), linked.alias("linked"),
    )
    return told.unionByName(alone.select("doc_id", "t1", "t2", F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_class_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(False).alias("linked")))


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, n_words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """Rows (doc_id, class_id, n_links, n_class_links, component_id, kept), one for each row of docs.

    Texts with the same set of n-grams are one class, named by its least doc_id,
    so copies are handled once. Classes whose MinHash bands meet and whose
    sketches don't rule it out fall into one cluster; inside a cluster all
    pairs are compared by their full sets, block against block, and only counts
    leave a task. Blocks hold so many n-grams that a pair of them fills a task,
    so that a cluster's sets are copied once for each block, not for each
    document. n_links: other documents with Jaccard >= threshold, copies
    included; n_class_links: other classes; component_id: the least doc_id
    reachable by links; kept: whether the row leads its component.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.
    A text with fewer than n_words words is one n-gram; texts without words and
    null texts link with nothing, are their own class and are kept. Rows with
    the same id are told apart by their text; of equal rows each counts, and
    all are kept if one is. A null id is a document like others, but ranks last
    in naming a class and leading a component. Other columns are ignored; an
    empty table gives no row.
    """
    return _judged(docs, threshold, n_words, recall).drop("t1", "t2", "linked")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n_words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """docs with one row of each group of linked documents: that of the least doc_id, by text where ids tie. All columns stay.

    A row is told by its id and its text together, so that rows which share an
    id, or have none, go only if they have a copy themselves. Of equal rows that
    lead a group one stays, any of them. Texts without words, null and empty
    ones stay, all of them; an empty table stays empty. Columns that begin with
    two underscores are reserved.
    """
    judged = settle(_judged(docs, threshold, n_words, recall).filter("linked").select(F.xxhash64("doc_id").alias("__t0"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "kept").groupBy("__t0", "__t1", "__t2").agg(F.first("kept").alias("__kept"), F.count("*").alias("__n")))
    keys = ["__t0", "__t1", "__t2"]
    keyed = docs.withColumns({"__t0": F.xxhash64("doc_id"), "__t1": text_key()[0], "__t2": text_key()[1]})
    gone, repeated = judged.filter("not __kept").select(keys), judged.filter("__kept and __n > 1").select(keys)

    def without(rows: DataFrame, those: DataFrame) -> DataFrame:
        if is_small(those):
            return rows.join(F.broadcast(those), keys, "left_anti")
        return join_unique(rows, those.withColumn("__in", F.lit(True)), keys, "left").filter("__in is null").drop("__in")

    left = without(keyed, gone)
    if not repeated.isEmpty():
        once = join_unique(keyed, repeated, keys).dropDuplicates(keys)
        left = without(left, repeated).unionByName(once)
    return left.select(docs.columns)
