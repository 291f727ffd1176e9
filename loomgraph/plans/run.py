"""Runs a program on a graph file, with the options its users know, and times the rounds."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph
from ..operators.partition import by_destination, by_source
from ..sources.files import read_graph
from . import algorithms

#: Programs by name; each takes (graph, source).
PROGRAMS = {
    "bfs": algorithms.bfs,
    "betweenness": algorithms.betweenness,
    "components": lambda g, _: algorithms.components(g),
    "pagerank": lambda g, _: algorithms.pagerank(g),
    "pagerank_delta": lambda g, _: algorithms.pagerank_delta(g),
    "bellman_ford": algorithms.bellman_ford,
    "spmv": lambda g, _: algorithms.spmv(g),
}


def run(spark: SparkSession, program: str, path: str, fmt: str = "text", symmetric: bool = False, source: int = 100, rounds: int = 1, num_partitions: int | None = None, partition_by: str = "dest", phases: dict[str, float] | None = None) -> tuple[DataFrame, list[float]]:
    """(result, seconds of each round); phases, if given, gets the seconds of reading and of degrees too. Reading and dealing out the edges are no part of a round; the result is that of the last.

    partition_by: dest or source; num_partitions defaults to the session's
    shuffle partitions. source is read by bfs, betweenness and bellman_ford
    alone and must be in the graph.
    """
    if rounds < 1:
        raise ValueError(f"rounds: {rounds}")
    phases = {} if phases is None else phases
    began = time.perf_counter()
    deal = {"dest": by_destination, "source": by_source}[partition_by]
    graph: Graph = deal(read_graph(spark, path, fmt, symmetric), num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))).cached()
    graph.n, graph.m  # noqa: B018
    phases["read"] = time.perf_counter() - began
    began = time.perf_counter()
    graph.held_degrees.count()
    phases["degrees"] = time.perf_counter() - began
    took, out = [], None
    for _ in range(rounds):
        if out is not None:
            out.unpersist()
        began = time.perf_counter()
        out = PROGRAMS[program](graph, source).persist()
        out.count()
        took.append(time.perf_counter() - began)
    phases["rounds"] = sum(took)
    graph.unpersist()
    return out, took


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m loomgraph.plans.run")
    p.add_argument("program", choices=sorted(PROGRAMS))
    p.add_argument("path")
    p.add_argument("out", help="folder for the result as Parquet")
    p.add_argument("-s", dest="symmetric", action="store_true")
    p.add_argument("-b", dest="fmt", action="store_const", const="gr", default="text", help="the file is binary")
    p.add_argument("-r", dest="source", type=int, default=100)
    p.add_argument("-rounds", type=int, default=1)
    p.add_argument("-p", dest="num_partitions", type=int)
    p.add_argument("-P", dest="partition_by", choices=["dest", "source"], default="dest")
    given = vars(p.parse_args(args))
    out = given.pop("out")
    phases: dict[str, float] = {}
    result, took = run(SparkSession.builder.getOrCreate(), **given, phases=phases)
    began = time.perf_counter()
    result.write.mode("overwrite").parquet(out)
    phases["write"] = time.perf_counter() - began
    print(", ".join(f"{name}: {seconds:.3f} s" for name, seconds in phases.items()))
    print(f"average: {sum(took) / len(took):.3f} s over {len(took)}")


if __name__ == "__main__":
    main()
