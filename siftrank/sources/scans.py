"""Records that may hold their own separators, read from files that are split among tasks.

Whether a line end or a closing bracket ends a record depends on all the text
before it: on open quotes, and on how deep the brackets are nested.  That is
found by a prefix scan.  A file's text is cut at each separator, wherever its
splits lie; the first pass sums each split up as a function of the state it
starts in (inside a string or not, and the change of depth for either), the
functions of a file's splits are applied in order, one row per split, and the
second pass, knowing the state at the start of each split, puts the parts
together to records.  What begins in one split and ends in another meets by
its place in the file.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftrank.scratch import materialize, open_store, scratch_path

SPLITS_PER_FILE = 10_000  # states of splits in one file that a task looks its own up in
QUOTE = '"'

# State after a part, for a part that begins outside and inside a string, and the change of depth for each.
Step = Callable[[str], tuple[int, int, int, int]]


@dataclass(frozen=True)
class Form:
    """How records end: after a ``separator`` outside of strings at a depth of at most ``level``."""

    separator: str
    level: int
    step: Step


def delimited(sep: str) -> Form:
    """Lines whose fields may be quoted; a quote opens a string at the start of a field only, and is doubled inside."""
    s = re.escape(sep)
    field = rf'(?:"(?:[^"]|"")*"(?!")[^{s}]*|[^"{s}][^{s}]*|)'
    whole = re.compile(rf"{field}(?:{s}{field})*\Z")
    rest = re.compile(rf'(?:[^"]|"")*"(?!")[^{s}]*(?:{s}{field})*\Z')
    ends = re.compile(r'(?:[^"]|"")*"(?!")')

    def step(line: str) -> tuple[int, int, int, int]:
        if QUOTE not in line:
            return 0, 1, 0, 0
        outside = 0 if whole.match(line) else 1
        inside = 1 if not ends.match(line) or not rest.match(line) else 0
        return outside, inside, 0, 0

    return Form("\n", 0, step)


def bracketed(opening: str, closing: str, level: int) -> Form:
    """JSON whose records end with ``closing``; brackets in strings do not count."""
    escaped = re.compile(r"\\.", re.S)

    def step(part: str) -> tuple[int, int, int, int]:
        if QUOTE not in part:
            n = part.count(opening)
            return 0, 1, n - 1, 0
        pieces = (escaped.sub("", part) if "\\" in part else part).split(QUOTE)
        even, odd = "".join(pieces[::2]).count(opening), "".join(pieces[1::2]).count(opening)
        ends_inside = (len(pieces) - 1) % 2
        # The closing bracket itself counts where the part ends outside of a string.
        return ends_inside, 1 - ends_inside, even - (not ends_inside), odd - ends_inside

    return Form(closing, level, step)


def _parts(spark: SparkSession, path: str, form: Form) -> DataFrame:
    """The text between separators, in order inside each split."""
    return spark.read.option("lineSep", form.separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(3)))


def _split_states(parts: DataFrame, form: Form) -> DataFrame:
    """(file, split, inside, depth) at the start of each split."""
    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[int]] = {}
        for file, split, value in _lines(batches):
            now = found.setdefault((file, split), [0, 1, 0, 0])
            outside, inside, up, up_inside = form.step(value)
            for start in (0, 1):
                now[2 + start] += up_inside if now[start] else up
                now[start] = inside if now[start] else outside
        names = ["file", "split", "outside", "inside", "up", "up_inside"]
        columns = list(zip(*[(*key, *now) for key, now in found.items()])) or [()] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=names)

    def apply(splits: pd.DataFrame) -> pd.DataFrame:
        splits = splits.sort_values("split")
        inside, depth, out = 0, 0, []
        for row in splits.itertuples():
            out.append((row.file, row.split, inside, depth))
            depth += row.up_inside if inside else row.up
            inside = row.inside if inside else row.outside
        return pd.DataFrame(out, columns=["file", "split", "inside", "depth"])

    functions = parts.mapInArrow(sum_up, "file string, split long, outside long, inside long, up long, up_inside long")
    return functions.groupBy("file").applyInPandas(apply, "file string, split long, inside long, depth long")


def records(spark: SparkSession, path: str, form: Form) -> DataFrame:
    """(value, first): all records of the files, and whether a record is the first of its file.

    A record has its inner separators and not the last one.  Any number of tasks
    may share a file, and a record may lie in several splits.
    """
    parts = _parts(spark, path, form)
    states = materialize(_split_states(parts, form), "split_states")
    folders = max(1, -(-states.count() // SPLITS_PER_FILE))
    where = scratch_path(spark, "split_states")
    folder = F.pmod(F.crc32(F.encode("file", "UTF-8")), F.lit(folders)).cast("int")
    states.withColumn("folder", folder).write.partitionBy("folder").parquet(where)

    def state_of(file: str, split: int) -> tuple[int, int]:
        import pyarrow.parquet as pq

        store, plain = open_store(f"{where}/folder={zlib.crc32(file.encode()) % folders}")
        own = [("file", "=", file), ("split", "=", split)]
        row = pq.read_table(plain, filesystem=store, partitioning=None, filters=own).to_pylist()[0]
        return row["inside"], row["depth"]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("value", pa.string()), ("first", pa.bool_()), ("file", pa.string()), ("split", pa.int64()),
                           ("at", pa.int32())])
        place, inside, depth, begun, first = None, 0, 0, True, False
        held: list[str] = []
        rows: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), shape.types)], schema=shape)
                rows.clear()

        def leave() -> None:
            """What is left at the end of a split: the start of a record (1), or a part without start and end (0)."""
            if held:
                rows.append((form.separator.join(held), first and begun, *place, 1 if begun else 0))
                held.clear()

        for file, split, value in _lines(batches):
            if (file, split) != place:
                leave()
                place = file, split
                inside, depth = state_of(file, split)
                begun = not inside and depth <= form.level
                first = split == 0
            outside, after, up, up_inside = form.step(value)
            depth += up_inside if inside else up
            inside = after if inside else outside
            held.append(value)
            if not inside and depth <= form.level:
                text = form.separator.join(held)
                held.clear()
                # The end of a record that an earlier split began is a part (0), like a whole one without its start.
                rows.append((text, first, None, None, None) if begun else (text, False, *place, 0))
                begun, first = True, False
                if len(rows) >= 1000:
                    yield from flush()
        leave()
        yield from flush()

    found = materialize(parts.mapInArrow(assemble, "value string, first boolean, file string, split long, at int"), "records")
    line = Window.partitionBy("file").orderBy("split", "at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = found.filter("file is not null").withColumn("record", F.sum("at").over(line))
    in_place = F.sort_array(F.collect_list(F.struct("split", "at", "value")))
    joined = pieces.groupBy("file", "record").agg(
        F.array_join(F.transform(in_place, lambda p: p["value"]), form.separator).alias("value"),
        F.max("first").alias("first"))
    return found.filter("file is null").select("value", "first").unionByName(joined.select("value", "first"))
