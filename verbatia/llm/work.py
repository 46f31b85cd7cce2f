"""Shared pieces: written intermediate tables, bounded broadcasts, connected components."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers that may be broadcast; beyond that many the same join is left to a shuffle.
BROADCAST_IDS = 250_000
#: Bytes of an Arrow batch of texts; the JVM and the Python worker of every core hold a few of them.
ARROW_BYTES = "4m"
#: Spark's setting by which a query removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_BYTES``, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, ARROW_BYTES)


def give_back() -> None:
    """Return what a finished task has freed: Python workers live on, and hold it through the stages that follow."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Workspace:
    """Tables written as Parquet below ``spark.checkpoint.dir``, which all executors share.

    A written table cuts the lineage, so that the loss of an executor repeats the last step only.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file:///tmp/checkpoints"
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table; Spark removes the shuffle files of the write when it ends, since no later step reads them."""
        path, kept = f"{self.root}/{name}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if kept is None else self.spark.conf.set(CLEANUP, kept)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def restrict(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` with (or without: ``left_anti``) a key in ``keys``, a written table.

    The keys are counted first and broadcast up to ``bound`` rows, so that wide rows without a key
    are never shuffled; beyond the bound the join is an ordinary shuffled one.
    """
    return df.join(F.broadcast(keys) if keys.count() <= bound else keys, on, how)


def components(edges: DataFrame, ws: Workspace, tag: str) -> DataFrame:
    """Connected components of undirected ``(a, b)`` longs: rows ``(node, comp)``, comp the least node.

    Alternates large-star and small-star steps until the edge set no longer changes. Every step is a partial aggregation
    and a join on one end; what is joined is written before, so that adaptive execution can split the rows of a hub.
    """
    now = ws.save(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{tag}-0",
    )
    mark, step = None, 0
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = ws.save(low.select("u", F.least("u", "m").alias("m")), f"{tag}-low")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.save(large.filter("u <> v").distinct(), f"{tag}-large")
        low = ws.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        new = ws.save(small, f"{tag}-{step}")
        got = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        ws.drop(f"{tag}-{step - 1}", f"{tag}-large", f"{tag}-low")
        now = new
        if tuple(got) == mark:
            break
        mark = tuple(got)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
