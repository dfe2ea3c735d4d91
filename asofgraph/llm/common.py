"""Helpers that several corpus operators share: shared storage, batches, components."""

from __future__ import annotations

import ctypes
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: space and 0x09 to 0x0D. Fixed by contract.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, one under /tmp if all run on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def remove(stored: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing is going to read it again."""
    spark, path = stored.sparkSession, stored._stored_at
    _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``limit`` bytes in ``column``, one row at least."""
    try:
        for batch in batches:
            lengths = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
            total, start = np.cumsum(lengths, dtype=np.int64), 0
            while start < batch.num_rows:
                base = total[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
                yield batch.slice(start, stop - start)
                start = stop
    finally:
        give_back()


def give_back() -> None:
    """Hands freed memory back to the system: a Python worker lives on for tasks that need less."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows an Arrow batch from here on in this session: whole texts go through, several MB a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, for the links left[i] - right[i]."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        differ = a != b
        if not differ.any():
            break
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(hop := root[root], root):
            root = hop
    return root


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node that each end of an edge (u, v) can reach.

    Rounds go on until nothing changes; with ``max_rounds``, a graph that needs more is an error.

    Alternating large-star and small-star rounds. Each round is a partially aggregated minimum
    and a join that adaptive execution may split, so a node with very many links needs no single
    task. Every round is written to the shared folder, in place of the one before; the driver
    sees two numbers a round.
    Nodes without an edge between different nodes do not appear.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    now = materialize(tidy(edges), "edges")
    before = state(now)
    for done in itertools.count():
        if not before[0]:
            break
        if done == max_rounds:
            raise RuntimeError(f"components still change after {max_rounds} rounds")
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tidy(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), "m").union(low.select("u", "m"))
        last, now = now, materialize(tidy(small.toDF("u", "v")), "edges")
        remove(last)
        after = state(now)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    ).groupBy("node").agg(F.min("component").alias("component"))
