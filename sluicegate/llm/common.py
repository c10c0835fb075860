"""Shared helpers: table access, staged tables in the shared folder, ragged numpy gathers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, ship


#: Bytes of an Arrow batch that goes to a worker, where the session has Spark's default of 64 MB.
ARROW_BYTES, ARROW_BYTES_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(4 << 20)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with this package on the workers, fed with batches of bounded bytes (texts are long).

    Spark reads the bound when a job starts, so it is set for the session, where that has Spark's default.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(ARROW_BYTES) == ARROW_BYTES_DEFAULT:
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)

    def worked(batches):
        tidy(run.__module__)
        yield from run(batches)
        tidy(run.__module__)

    return df.mapInArrow(worked, schema)


def tidy(module: str) -> None:
    """Give back what a worker, which outlives its tasks, holds for other operators, and its free memory."""
    for name, other in list(sys.modules.items()):
        if name.startswith(__package__ + ".") and name != module and hasattr(other, "forget"):
            other.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder; Spark's reader alone touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it back.

    A lost executor then costs a reread of files, not a rerun of all that came before.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sluicegate-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sluicegate-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def chunks(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items with about `most` units of length each, one item at least."""
    n, start = len(lengths), 0
    ends = np.cumsum(lengths)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets of ragged rows: n + 1 entries, the first 0."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the ragged rows `rows` of (values, offsets): the values and each row's length."""
    begin = offsets[rows]
    size = offsets[rows + 1] - begin
    out = starts_of(size)
    take = np.arange(out[-1], dtype=np.int64)
    take += np.repeat(begin - out[:-1], size)
    return values[take], size


#: Ids up to this many (16 bytes each in a broadcast) are sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A narrow table for the build side of a join: broadcast if counted small, else hashed by partition."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("shuffle_hash")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component of every node of the edges (u, v): the least node that links reach.

    Alternating large-star and small-star steps: each node hands its neighbours to the least of
    them. Every step groups by node with partial aggregation and halves long chains, so a star
    or a chain of any size ends in a logarithmic number of steps; nothing is collected.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    state = None
    while True:
        before, pairs = now, both(now)
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = pairs.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        new = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if new == state and now.join(before, ["u", "v"], "left_anti").isEmpty():  # sums may agree by chance
            dropped(before)
            break
        state = new
        dropped(before)
    nodes = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    out = staged(nodes.unionAll(nodes.select(F.col("component").alias("node"), "component").distinct()), name)
    dropped(now)
    return out
