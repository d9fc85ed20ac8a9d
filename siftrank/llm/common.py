"""Helpers shared by the operators: columns of any input, Arrow texts, shared files, worker caches."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.scratch import materialize, open_store, scratch_path


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "8m"
FAN = 64  # states of tasks that are merged in one task


def named(df: DataFrame, column: str) -> Column:
    """Column by its exact top-level name, also when it holds dots or backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns an operator is about to add, compared as Spark compares names."""
    taken = {name.lower() for name in names}
    return df.select(*[named(df, c) for c in df.columns if c.lower() not in taken])


def whole_text(column: Column) -> Column:
    """Null texts are empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column without a copy, and the row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if not np.array_equal(lengths, np.diff(offsets)):
            column = pa.array(column.fill_null(""))
            return text_bytes(column)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


def string_groups(texts: list[str | None] | pa.Array, limit: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in lists of about ``limit`` characters; null is empty.  An Arrow column is turned into strings bit by bit."""
    group: list[str] = []
    size = 0
    for first in range(0, len(texts), 256):
        some = texts[first:first + 256]
        for text in some if isinstance(some, list) else some.to_pylist():
            group.append(text or "")
            size += len(group[-1])
            if size >= limit:
                yield group
                group, size = [], 0
    if group:
        yield group


def bound_batches(df: DataFrame) -> None:
    """Arrow batches of bounded bytes, however long the texts are; a session's own setting stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, BATCH_BYTES)


def release() -> None:
    """Give freed memory back to the system: idle workers share their machine with the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(function: Callable) -> Callable:
    """A batch function that gives its memory back when its task ends."""
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            release()

    return wrapped


def worker_state(name: str, make: Callable[[], object] = dict) -> object:
    """An object of this Python worker that later tasks of the same kind find again.

    The package's functions reach the workers by value, so their module
    globals do not outlive a task.  A worker keeps the object of one kind only.
    """
    home = sys.modules.setdefault("_siftrank_worker", types.ModuleType("_siftrank_worker"))
    kept = vars(home).get("kept")
    if kept is None or kept[0] != name:
        home.kept = None
        release()
        home.kept = kept = (name, make())
    return kept[1]


def packed_texts(texts: DataFrame) -> DataFrame:
    """(t1, t2, packed) of (t1, t2, text): each text once per task, compressed for the shuffle."""
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            new = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            data, offsets = text_bytes(batch.column(2))
            raw = [packer.compress(data[offsets[i]:offsets[i + 1]].tobytes()) for i in new]
            keep = pa.array(new, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(raw, pa.binary())],
                                             names=["t1", "t2", "packed"])

    return texts.mapInArrow(tidy(squeeze), "t1 long, t2 long, packed binary")


def shared_folder(df: DataFrame, name: str) -> str:
    """A new folder for files below ``spark.checkpoint.dir``."""
    return scratch_path(df.sparkSession, name)


def write_shared(path: str, chunks: Iterable[bytes]) -> int:
    """Write a whole file and give its size.  Callers put the task attempt in the name."""
    store, plain = open_store(path)
    store.create_dir(plain.rsplit("/", 1)[0], recursive=True)
    size = 0
    with store.open_output_stream(plain) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return size


def part_number() -> int:
    """Number of this task among those of its stage."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def merged_state(rows: DataFrame, sum_up: Callable[[Iterator[pa.RecordBatch]], bytes], merge: Callable[[list[bytes]], bytes],
                 name: str) -> bytes | None:
    """One state of bounded size for all rows: each task sums its batches up, and tasks' states are merged ``FAN`` at a time.

    States are merged in the order of the tasks, so a sum of floats comes out the
    same each time.  None for an input without a partition.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = sum_up(batches)
        yield pa.RecordBatch.from_arrays([pa.array([part_number()], pa.int64()), pa.array([state], pa.binary())], names=["part", "state"])

    def again(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("part")
        return pd.DataFrame({"part": [int(some["part"].iloc[0]) // FAN], "state": [merge(some["state"].tolist())]})

    shape = "part long, state binary"
    level = materialize(rows.mapInArrow(tidy(first), shape), name)
    while level.count() > 1:
        level = materialize(level.groupBy((F.col("part") / FAN).cast("long")).applyInPandas(again, shape), name)
    last = level.first()
    return bytes(last["state"]) if last else None


def task_name(stem: str, end: str) -> str:
    """File name of this task attempt; a retried or doubled task writes another file."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{stem}-{context.partitionId():06d}-{context.taskAttemptId()}{end}"


def wider(df: DataFrame, **columns: str) -> T.StructType:
    """Schema of ``df`` with further columns (``DataFrame.schema`` itself must not be changed)."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(k)) for n, k in columns.items()]])


def list_of(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
