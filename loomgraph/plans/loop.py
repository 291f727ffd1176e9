"""Supersteps: what a round made is held in memory, and lineage is cut by a written table every few rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; one of our own only where none is set and all work is done on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that is deleted when the driver's JVM exits, if delete() wasn't called before."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, *metrics: Column) -> tuple[DataFrame, list, str]:
    """(df written to the shared folder and read back, the metrics over it, its path). The job that writes gathers the metrics."""
    spark = df.sparkSession
    path, seen = new_path(spark), Observation()
    named = [m.alias(f"m{k}") for k, m in enumerate(metrics)]
    (df.observe(seen, *named) if named else df).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    values = []
    if named:
        told = seen.get
        # A plan that the optimiser knows to be empty has no metrics.
        values = [told[f"m{k}"] for k in range(len(named))] if len(told) == len(named) else list(back.agg(*named).first())
    return back, values, path


class Rounds:
    """Holds the state of a loop, one job a round: the one that makes the state also gathers the metrics.

    A held table that loses an executor is made again from the last written
    one, at most `every` rounds back. A round reads the state twice, as what is
    sent and as what is kept, so a plan doubles with every held round: hold few.
    What no later round reads is freed, so two states exist at most.
    """

    def __init__(self, every: int = 2):
        self.every, self.count, self.live, self.path = every, 0, [], None

    def hold(self, df: DataFrame, *metrics: Column) -> tuple[DataFrame, list]:
        """(df materialised, the metrics over it)."""
        self.count += 1
        metrics = metrics or (F.count("*"),)
        if self.count % self.every:
            kept = df.persist()
            self.live.append(kept)
            return kept, list(kept.agg(*metrics).first())
        kept, values, path = written(df, *metrics)
        self.free()
        self.path = path
        return kept, values

    def free(self) -> None:
        """Gives up all states: none is read any more, but for one that was just written."""
        for x in self.live:
            x.unpersist()
        if self.path:
            delete(self.spark, self.path)
        self.live, self.path = [], None

    @property
    def spark(self) -> SparkSession:
        return SparkSession.active()
