"""Shared helpers of the training-data operators: durable scratch tables and union-find."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors: spark.checkpoint.dir.

    Where the setting is absent (a local session, as in tests) a temporary folder of this
    process is used and removed at exit. A cluster without the setting is an error, since a
    machine-local folder would not be seen by the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="palimpsest-"))
        atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
    return "file://" + _local_root[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that materialize() made, once nothing that is still to run reads them; others stay."""
    for df in tables:
        at = df.__dict__.get("_scratch_path")
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the files of finished shuffles deleted now: Spark does so when the driver collects their handles, which on
    a driver with a large heap may be long after the last job that reads them."""
    gc.collect()
    spark._jvm.System.gc()


def lean(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``step`` that gives its memory back to the system when its task ends: Python workers live on, and what one
    stage held would otherwise add to what the next ones need."""

    def run(batches: Iterator) -> Iterator:
        yield from step(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
        if trim:
            trim(0)

    return run


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes behind ``df`` (file sizes for a scan); nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int, most: int = 200_000) -> int:
    """Shuffle width that grows with the input and is never under the session's setting, which also stands
    where Catalyst knows no size (as for rows that were handed over by the driver)."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    if size >= 1 << 60:
        return least
    return max(least, min(most, -(-size // bytes_each)))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as keep it apart from the columns of ``df``."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def crc32_of(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Union-find over ``edges(a, b)``: one row ``(node, root)`` per node, root the smallest member.

    Each round points every node at its smallest neighbour, follows those pointers twice more, and
    contracts the graph onto the pointed-at nodes, so a chain of length L needs about log4(L)
    rounds. Minima are partial aggregates (a hub's edges are combined before the shuffle); joins
    are plain equi-joins that adaptive execution can split. Every round is written to the shared
    scratch folder. Self-loops and null ends are ignored; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    live = materialize(edges.select(F.col("a"), F.col("b")).where("a <> b").distinct(), f"{tag}-e")
    levels: list[DataFrame] = []
    while not live.isEmpty():
        both = live.union(live.select(F.col("b"), F.col("a")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to"))
        step = first = materialize(least, f"{tag}-m")
        for _ in range(2):
            onward = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = step.join(onward, "to").select("node", F.col("next").alias("to"))
        step = materialize(step, f"{tag}-p")
        discard(first)
        levels.append(step)
        left, right = (step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        onto = materialize(
            live.join(left, "a").join(right, "b")
            .select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b"))
            .where("a <> b").distinct(), f"{tag}-e")
        discard(live)
        live = onto
    discard(live)
    if not levels:
        return spark.createDataFrame([], f"node {edges.schema['a'].dataType.simpleString()}, root {edges.schema['a'].dataType.simpleString()}")
    roots = levels[-1].select("node", F.col("to").alias("root"))
    for step in reversed(levels[:-1]):
        up = roots.select(F.col("node").alias("to"), F.col("root"))
        roots = step.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    out = materialize(roots, f"{tag}-r")
    discard(*levels)
    return out
