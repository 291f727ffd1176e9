"""Embedding whitening by a tiled covariance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import finite_rows, floored

#: Entries are floor(SCALE * c) + 1,000,000; the shift cancels out of every result.
SCALE, COMPONENTS = 64, 32
#: Rows of a block, narrowest column block, column blocks at most, and dimensions at most (a matrix of theirs is decomposed by the driver).
ROW_BLOCK, TILE, MOST_TILES, MOST_DIM = 1024, 32, 4, 8192
#: The partial sums of a tile, one of each task, are added in so many groups before they meet.
FAN = 64
#: Entries beyond this are an error: n of them are summed in 63 bits.
MOST = 1 << 40

Read = Callable[[pa.RecordBatch], np.ndarray]


def commonest_length(rows: DataFrame) -> int:
    """Components that most finite vectors have, the greater number on a tie; 0 without vectors."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.filter(v.isNotNull() & (F.size(v) > 0) & good).groupBy(F.size(v).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return found.dim if found else 0


def _packed(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes of an entry, data); whole numbers in the narrowest type, 0 for doubles."""
    if x.dtype.kind == "f":
        return 0, np.ascontiguousarray(x).tobytes()
    top = int(np.abs(x).max(initial=0))
    size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return size, x.astype(f"<i{size}").tobytes()


def _unpacked(size: int, data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{size}" if size else "<f8").reshape(-1, width)


def _column_blocks(read: Read, width: int, tiles: int):
    """Vectors -> column blocks of row-blocks, each sent to the tiles that it is a factor of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = read(batch)
            for a in range(0, len(x), ROW_BLOCK):
                rows = []
                for col in range(tiles):
                    size, data = _packed(x[a : a + ROW_BLOCK, col * width : (col + 1) * width])
                    rows += [(min(col, o), max(col, o), (part << 32) + made, col, size, data) for o in range(tiles)]
                made += 1
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["ti", "tj", "row_block", "col", "size", "data"])

    return run


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _products(centre: np.ndarray, n: int, width: int):
    """Column blocks in order of tile and row-block -> one product for each tile of a task, of blocks centred exactly before they are multiplied."""

    def centred(col: int, size: int, data: bytes) -> np.ndarray:
        own = centre[col * width : (col + 1) * width]
        x = _unpacked(size, data, len(own))
        return x - own if not size else (n * x.astype(np.int64) - own) / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = _rows(batches, ["ti", "tj", "row_block", "col", "size", "data"])
        for (ti, tj), tile in groupby(rows, lambda r: r[:2]):
            total = None
            for _, blocks in groupby(tile, lambda r: r[2]):
                of = {r[3]: centred(*r[3:]) for r in blocks}
                product = of[ti].T @ of[tj]
                total = product if total is None else total + product
            yield _partial(ti, tj, part, total)

    return run


def _partial(ti: int, tj: int, part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([ti], pa.int32()), pa.array([tj], pa.int32()), pa.array([part], pa.int64()), pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], ["ti", "tj", "part", "total"])


_PARTIAL = "ti int, tj int, part long, total binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (ti, tj), tile in groupby(_rows(batches, ["ti", "tj", "total", "part"]), lambda r: r[:2]):
        total, part = None, 0
        for _, _, data, part in tile:
            x = np.frombuffer(data)
            total = x if total is None else total + x
        yield _partial(ti, tj, part, total)


def tiled_covariance(rows: DataFrame, read: Read, centre: np.ndarray, n: int) -> np.ndarray:
    """(dim, dim): the products of the centred columns of rows, summed and divided by n.

    read makes a matrix of a batch of rows: whole numbers x, whose centre is
    their sum and which become (n * x - sum) / n, or doubles, whose centre is
    taken off as it is. Column blocks meet by tile and row-block, so a task
    multiplies two blocks at a time and keeps one tile; each tile's partial
    sums are added in groups, then together. rows must come in the same order
    whenever they are read, as they do from files.
    """
    dim = len(centre)
    width = max(TILE, -(-dim // MOST_TILES))
    tiles = -(-dim // width)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.mapInArrow(_column_blocks(read, width, tiles), "ti int, tj int, row_block long, col int, size int, data binary")
    blocks = blocks.repartition(parts, "ti", "tj", "row_block").sortWithinPartitions("ti", "tj", "row_block", "col")
    sums = blocks.mapInArrow(_products(centre, n, width), _PARTIAL)
    group = F.pmod("part", F.lit(FAN))
    sums = sums.repartition(parts, "ti", "tj", group).sortWithinPartitions("ti", "tj", "part").mapInArrow(_added, _PARTIAL)
    sums = sums.repartition(parts, "ti", "tj").sortWithinPartitions("ti", "tj", "part").mapInArrow(_added, _PARTIAL)
    out = np.zeros((dim, dim))
    for r in sums.collect():  # tiles * (tiles + 1) / 2 rows
        i, j = slice(r.ti * width, min(dim, (r.ti + 1) * width)), slice(r.tj * width, min(dim, (r.tj + 1) * width))
        tile = np.frombuffer(r.total).reshape(i.stop - i.start, j.stop - j.start)
        out[i, j], out[j, i] = tile, tile.T
    return out / n


def _sums(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=object)
        for batch in batches:
            x = floored(finite_rows(batch.column(0), dim)[1], scale, MOST)
            n += len(x)
            total += x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["n", "sums"])

    return run


def sums_of(rows: DataFrame, dim: int, scale: int) -> tuple[int, np.ndarray]:
    """(n, sums of floor(scale * c) by dimension), exact: a row of sums for each task, added by dimension."""
    parts = rows.select("v").mapInArrow(_sums(dim, scale), "n long, sums array<string>")
    added = parts.select("n", F.posexplode("sums").alias("dim", "part")).groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    sums = np.zeros(dim, dtype=np.int64)
    for r in added:
        sums[r.dim] = int(r.total)
    return (added[0].n if added else 0), sums


def _deviation(x: np.ndarray, sums: np.ndarray, n: int) -> list[int]:
    """Sum over dimensions of (n * x - S)**2; S and x may both lack the shift, which cancels."""
    top = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if x.shape[1] * top * top < 1 << 63:
        d = n * x - sums
        return np.einsum("ij,ij->i", d, d).tolist()
    d = n * x.astype(object) - sums.astype(object)
    return (d * d).sum(1).tolist()


def _project(sums: np.ndarray, n: int, axes: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Rows of floor(scale * c) -> whitened rows."""
    return lambda x: ((n * x - sums) / n) @ axes


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error): each kept vector along each leading component.

    An entry c becomes the whole number x = floor(scale * c) + 1,000,000; the shift
    cancels out of all results, and isn't carried along. The covariance of all kept vectors (divisor n) is summed from tiles of
    dimension pairs, and decomposed; components are numbered from 1 by falling
    eigenvalue e, up to `components` or the number of dimensions. whitened is
    (x - mean) projected on the unit eigenvector, over sqrt(e); explained is e
    over the trace; deviation, a decimal, is the exact sum over dimensions of
    (n * x - S)**2. identity_error tells how well it went, by a second tiled
    covariance, of the whitened rows themselves: its largest difference from
    the identity. Vectors are read anew for each pass; the driver holds one
    matrix of dimension pairs.

    Vectors that are null or empty or hold null or non-finite entries are
    dropped, and so are those whose length isn't the commonest (the greater on
    a tie), for no covariance has both. Where e is 0 to working precision, as
    for equal vectors or fewer vectors than dimensions, whitened is null and
    the component has no part in identity_error; explained is null where the
    trace is 0, identity_error where no component is left. Repeated rows and
    ids count each time; null ids are rows like any other. An empty table gives
    no row. Columns other than the id and the vector are ignored.
    """
    rows = vectors.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    dim = commonest_length(rows)
    if dim > MOST_DIM:
        raise ValueError(f"{dim} dimensions: the driver decomposes a matrix of {MOST_DIM} at most")
    n, sums = sums_of(rows, dim, scale) if dim else (0, np.zeros(0, np.int64))
    top = min(components, dim)
    explained, error, axes = [None] * top, None, np.zeros((dim, 0))
    if n:
        whole = lambda batch: floored(finite_rows(batch.column(0), dim)[1], scale, MOST)
        cov = tiled_covariance(rows.select("v"), whole, sums, n)
        e, u = np.linalg.eigh(cov)
        e, u = e[::-1][:top], u[:, ::-1][:, :top]
        trace = float(np.trace(cov))
        explained = [float(x / trace) for x in e] if trace > 0 else explained
        full = int((e > max(e[0], 0) * dim * np.finfo(float).eps).sum())
        axes = u[:, :full] / np.sqrt(e[:full])
        if full:
            project = _project(sums, n, axes)
            again = tiled_covariance(rows.select("v"), lambda batch: project(whole(batch)), np.zeros(full), n)
            error = float(np.abs(again - np.eye(full)).max())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _project(sums, n, axes)
        for batch in batches:
            at, x = finite_rows(batch.column(1), dim)
            x = floored(x, scale, MOST)
            w = project(x)
            rest = [None] * (top - w.shape[1])
            lists = pa.array([[*r, *rest] for r in w.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([str(d) for d in _deviation(x, sums, n)], pa.string()), lists], ["id", "deviation", "whitened"])

    made = rows.mapInArrow(apply, f"id {kind}, deviation string, whitened array<double>") if n else rows.limit(0).select("id", F.lit("0").alias("deviation"), F.array(F.lit(0.0)).alias("whitened"))
    told: Column = F.array(*[F.lit(x).cast("double") for x in explained]) if explained else F.array().cast("array<double>")
    out = made.select(F.col("id").alias(ident), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return out.select(ident, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(told, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
