"""Graphs as DataFrames: vertices(id), edges(src, dst, w, eid)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """vertices(id) holds every vertex, isolated ones too; edges(src, dst, w, eid) keeps loops and parallel edges.

    eid is the place of the edge in its source's list, where the source of the
    data has one; null otherwise. index, where there is one, reads the out-edges
    of a few vertices without reading all (plans.layout.indexed).
    """

    vertices: DataFrame
    edges: DataFrame
    symmetric: bool = False
    index: Any = None
    #: Tables held for as long as the graph is read.
    owned: tuple[DataFrame, ...] = ()

    @cached_property
    def n(self) -> int:
        return self.vertices.count()

    @cached_property
    def m(self) -> int:
        return self.edges.count()

    def transpose(self) -> Graph:
        """Edges turned round; a symmetric graph is its own transpose."""
        if self.symmetric:
            return self
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "eid"))

    def symmetrize(self) -> Graph:
        """Each edge in both directions; parallel edges that arise stay."""
        if self.symmetric:
            return self
        return Graph(self.vertices, self.edges.unionByName(self.transpose().edges), True)

    def out_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def in_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree) of every vertex, 0 where it has no edge: one shuffle of the edge ends, of one end if they are symmetric."""
        if self.symmetric:
            ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("d")).unionByName(self.vertices.select("id", F.lit(0).alias("d")))
            return ends.groupBy("id").agg(F.sum("d").alias("out_degree")).withColumn("in_degree", F.col("out_degree"))
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        none = self.vertices.select("id", F.lit(0).alias("o"), F.lit(0).alias("i"))
        return ends.unionByName(none).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))

    @cached_property
    def held_degrees(self) -> DataFrame:
        """degrees(), held in memory until unpersist() if the edges are held too."""
        return self.degrees().persist() if self.edges.storageLevel.useMemory else self.degrees()

    def cached(self) -> Graph:
        edges = self.edges.persist()  # first, so that vertices derived from them read them from memory
        return Graph(self.vertices.persist(), edges, self.symmetric, self.index, self.owned)

    def unpersist(self) -> None:
        self.vertices.unpersist()
        self.edges.unpersist()
        if "held_degrees" in self.__dict__:
            self.held_degrees.unpersist()
        for x in self.owned:
            x.unpersist()
        if self.index is not None:
            self.index.free()


def from_edges(edges: DataFrame, vertices: DataFrame | None = None, symmetric: bool = False) -> Graph:
    """Graph of edges(src, dst[, w[, eid]]); w is 1 where absent, vertices are the ends where not given."""
    w = F.col("w") if "w" in edges.columns else F.lit(1).cast("long")
    eid = F.col("eid").cast("long") if "eid" in edges.columns else F.lit(None).cast("long")
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("w"), eid.alias("eid"))
    if vertices is None:
        vertices = edges.select(F.col("src").alias("id") if symmetric else F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(vertices.select(F.col("id").cast("long").alias("id")), edges, symmetric)
