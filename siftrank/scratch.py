"""Intermediate tables in the shared folder of the cluster.

A plan that reads the same expensive input several times writes it once as
parquet.  The written table survives the loss of executors, cuts the lineage,
and gives the optimizer a true size, so joins against small tables become
broadcasts by Spark's own threshold and stay shuffles beyond it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


SPLIT_BYTES = 128 << 20  # spark.sql.files.maxPartitionBytes: a smaller input is one split or few
TINY_BYTES = 64 << 10    # not worth a shuffle
PART_BYTES = 32 << 20    # input of one task whose work grows beyond its input
SORTED_ROWS = 500_000    # narrow rows that a task sorts

_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        return named.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="siftrank-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which is removed when the application ends."""
    context = spark.sparkContext
    own = f"{shared_dir(spark)}/siftrank-{context.applicationId}"
    folder = context._jvm.org.apache.hadoop.fs.Path(own)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def tagged_folders() -> Iterator[list[str]]:
    """The paths that this thread asks for inside the block."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables of ``materialize`` that no DataFrame in use reads any more."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def open_store(path: str):
    """File system and plain path of a file in the shared store (local, HDFS, S3, GCS), for Python workers."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path[len("file:"):]).lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def read_shared_parquet(path: str) -> pd.DataFrame:
    """A written file of bounded size as a frame, read by a Python worker."""
    import pyarrow.parquet as pq

    store, plain = open_store(path)
    return pq.read_table(plain, filesystem=store).to_pandas()


def read_shared_batches(path: str, rows: int) -> Iterator[pd.DataFrame]:
    """A written file in frames of at most ``rows``, read one after another by a Python worker."""
    import pyarrow.parquet as pq

    store, plain = open_store(path)
    with store.open_input_file(plain) as source:
        for batch in pq.ParquetFile(source).iter_batches(batch_size=rows):
            yield batch.to_pandas()


def materialize(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``materialize`` of the rows that ``make`` gives; the tables that it wrote on the way are removed.

    They would stay as long as a DataFrame made of them does, beside those of the steps that follow.
    """
    path = scratch_path(spark, name)
    with tagged_folders() as made:
        try:
            df = make()
            df.write.parquet(path)
        finally:
            remove_folders(spark, made)
    return spark.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, *calls: Callable[[], object]) -> list:
    """Results of calls that do not need each other; their jobs run side by side, so the last tasks of one leave no core idle."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        opened = [pool.submit(copy_context().run, inherit(call)) for call in calls]
    return [call.result() for call in opened]


def bucket_count(spark: SparkSession, wanted: int) -> int:
    """A bucket per core at least, and no more than the session allows a table to have."""
    allowed = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(max(spark.sparkContext.defaultParallelism, wanted), allowed)


def materialize_buckets(df: DataFrame, name: str, key: str, order: str, buckets: int) -> DataFrame:
    """Write ``df`` once in buckets of ``key``, sorted by ``order`` inside; grouping by the key needs no shuffle then.

    ``df`` comes from rows dealt out by the key in as many parts, so that a task writes one bucket.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"siftrank_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(order).option("path", path).saveAsTable(table)
    return spark.table(table)


def planned_bytes(df: DataFrame) -> int:
    """Optimizer's size of ``df``; the file size for a materialized table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and bytes of their values, counted by one pass.

    A compressed file says little about a table with many equal values, so
    this is what decides whether a table may be sent to every executor.
    """
    widths = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            widths.append(F.coalesce(F.octet_length(column), F.lit(0)) + 16)
        elif isinstance(field.dataType, T.ArrayType):
            widths.append(F.greatest(F.size(column), F.lit(0)) * 8 + 16)
        else:
            widths.append(F.lit(8))
    row = df.agg(F.count(F.lit(1)), F.sum(reduce(lambda a, b: a + b, widths).cast("long"))).first()
    return row[0], row[1] or 0


def memory_bytes(df: DataFrame) -> int:
    return measure(df)[1]


def broadcast_limit(spark: SparkSession) -> int:
    """Spark's own broadcast threshold in bytes (negative when switched off)."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    text = text.strip().lower()
    digits = text.rstrip("bkmg")
    return int(digits) * units.get(text[len(digits):] or "b", 1)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a small input comes in fewer splits than there are cores.

    An input with at least as many splits as cores is returned as it is, so no
    large table is ever shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not TINY_BYTES < planned_bytes(df) <= SPLIT_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def read_bytes(df: DataFrame) -> int:
    """Bytes of all files and tables the plan starts from; an optimizer's guess for a join can be any number."""
    conf = df.sparkSession.conf
    unknown = int(conf.get("spark.sql.defaultSizeInBytes", str(2 ** 63 - 1)))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        size = int(str(leaves.next().stats().sizeInBytes()))
        # Rows that come from a program have no size; they count as one ordinary shuffle.
        total += size if size < unknown else PART_BYTES * int(conf.get("spark.sql.shuffle.partitions"))
    return total


def fan_out(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Rows over all cores, ahead of a step that makes much work of few bytes.

    Adaptive execution would merge small partitions and leave the work to one
    task; it keeps a number that is asked for.  The number grows with the bytes
    that the plan reads, without a limit.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, read_bytes(df) // PART_BYTES), *keys)


def fan_out_rows(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Narrow rows by ``keys`` whose groups are small, ahead of steps that sort them: some ``SORTED_ROWS`` in a task.

    Adaptive execution goes by compressed bytes, of which narrow rows have few:
    a task would get millions, and sort them once per step.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // SORTED_ROWS)), *keys)
