"""Packing by minimum bin slack.

Each document's ids are cut into windows of the capacity and one remainder.
Remainders are packed by counts alone: as long as any are left, a bitset
subset-sum over the counted lengths, led by the longest one, finds the multiset
that fills a window closest to its capacity; it is traced back to counts and
used as often as the counts allow, so each step uses up a length.  The work on
the driver depends on the capacity only, never on the number of documents.

A window that no multiset fills is filled by cutting one piece, in
a step for many windows at once (``broken_fill``); the rests of the cut pieces
are one more length.  What remains at the very end is cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm.common import bound_batches, list_of, named, tidy, whole_text
from siftrank.llm.token_ids import encode_texts
from siftrank.scratch import materialize

CAPACITY = 2048
ROWS = 1 << 16            # rows the plan is applied to at a time
SPAN = 1 << 46           # more than the pieces of a length
FEW_PARTS = 100_000       # so many parts of cut pieces are joined by broadcast


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths with the largest sum within the capacity, the longest length among them."""
    longest = max(counts)
    start = 1 << longest
    reach, steps, mask = start, [], (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = counts[length] - (length == longest)
        left = min(left, (capacity - longest) // length)
        size = 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            size *= 2
        if reach >> capacity:
            break
    total = reach.bit_length() - 1
    use = {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            use[length] = use.get(length, 0) + take
            total -= length * take
    return use


def broken_fill(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """A fill short of the capacity and a length longer than what it lacks, for many windows at once.

    A length gives a window only what it can give to as many windows as the
    longest one fills alone; so each step uses up a share of the longest
    length, which depends on the capacity only.
    """
    longest = max(counts)
    windows = max(1, counts[longest] // (capacity // longest + 1))
    while True:
        given = {k: n // windows for k, n in counts.items() if n >= windows}
        use = best_fill(given, capacity)
        # A length of which some is left is longer than the slack, else it were in the fill.
        left = [k for k, n in given.items() if n > use.get(k, 0)]
        if left:
            return use, max(left, key=lambda k: (counts[k] // (use.get(k, 0) + 1), -k))
        windows //= 2


@dataclass
class Plan:
    """Where the k-th piece of each length goes, by arithmetic runs.

    ``runs``: (length, first, last, start, size, per_sequence, phase, sequence,
    offset): of pieces first..last-1 of a length, the ids from ``start`` on,
    ``size`` of them, fill consecutive sequences, ``per_sequence`` in each, from
    ``offset`` on; ``phase`` of them are in ``sequence`` before.  A piece that is
    cut is in one run for each of its parts.
    """
    runs: list[tuple[int, int, int, int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack pieces of the counted lengths (1 to capacity)."""
    plan = Plan()
    counts = {int(k): int(n) for k, n in histogram.items() if k < capacity and n}
    whole = histogram.get(capacity, 0)
    if whole:
        plan.runs.append((capacity, 0, whole, 0, capacity, 1, 0, 0, 0))
        plan.sequences = whole
    # What is left of each length: (length, first, last, start) of whole pieces, and of the rests of cut ones.
    stock = {k: deque([(k, 0, n, 0)]) for k, n in counts.items()}

    def take(length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """The next ``n`` pieces of a length."""
        counts[length] -= n
        if not counts[length]:
            del counts[length]
        while n:
            of, first, last, start = stock[length].popleft()
            end = min(last, first + n)
            if end < last:
                stock[length].appendleft((of, end, last, start))
            n -= end - first
            yield of, first, end, start

    def place(length: int, times: int, per: int, offset: int, size: int) -> None:
        """The first ``size`` ids of ``per`` pieces in each of the next ``times`` windows; the rests go back."""
        rest, done = length - size, 0
        for of, first, last, start in list(take(length, times * per)):
            plan.runs.append((of, first, last, start, size, per, done % per, plan.sequences + done // per, offset))
            done += last - first
            if rest:
                counts[rest] = counts.get(rest, 0) + last - first
                stock.setdefault(rest, deque()).append((of, first, last, start + size))

    left = sum(k * n for k, n in counts.items())
    while left >= capacity:
        use = need = best_fill(counts, capacity)
        slack = capacity - sum(k * n for k, n in use.items())
        if slack:
            use, broken = broken_fill(counts, capacity)
            slack = capacity - sum(k * n for k, n in use.items())
            need = {**use, broken: use.get(broken, 0) + 1}
        times = min(counts[k] // n for k, n in need.items())
        at = 0
        for length, per in sorted(use.items(), reverse=True):
            place(length, times, per, at, length)
            at += length * per
        if slack:
            place(broken, times, 1, at, slack)
        plan.sequences += times
        left -= times * capacity
    while left:
        size = 1 << (left.bit_length() - 1)
        at = 0
        while at < size:
            length = max(counts)
            part = min(length, size - at)
            place(length, 1, 1, at, part)
            at += part
        plan.sequences += 1
        left -= size
    return plan


def row_ranges(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of about ``limit`` rows over entries of the given sizes; a larger entry is a slice of its own."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield slice(first, last)
        first = last


def _pieces(capacity: int, path: str, cut: str, end_id: int | None):
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, checks, ends = [], [], [0]
            for raw in encode_texts(path, cut, batch.column(batch.num_columns - 1)):
                raw += tail
                sizes.append(len(raw) // 4)
                checks.extend(zlib.crc32(raw[at:at + 4 * capacity]) for at in range(0, len(raw), 4 * capacity))
                ends.append(len(checks))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64()),
                 list_of(np.array(checks, dtype=np.int64), np.array(ends), pa.int64())],
                names=[*batch.schema.names[:-1], "doc_tokens", "checks"])

    return measure, tail


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, cut: str = "bytes", end_id: int | None = 1,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and has the end id only (no piece if there is no end
    id); rows with equal or null document ids are packed each for itself; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(docs)
    measure, tail = _pieces(capacity, path, cut, end_id)
    rows = docs.select(
        named(docs, doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        F.xxhash64(whole_text(named(docs, text))).alias("h1"),
        F.xxhash64(F.lit(1), whole_text(named(docs, text))).alias("h2"), whole_text(named(docs, text)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sized = materialize(rows.mapInArrow(
        tidy(measure), f"doc_id {kind}, row long, h1 long, h2 long, doc_tokens long, checks array<bigint>"), "packing_sizes")

    pieces = sized.select("doc_id", "row", "h1", "h2", "doc_tokens", F.posexplode("checks").alias("no", "ids_crc32"))
    pieces = pieces.withColumn("start", F.col("no").cast("long") * capacity).withColumn(
        "length", F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("start"))).drop("no")
    # The k-th piece of its length: counted by input partition first, so that no length meets in one task.
    pieces = pieces.withColumn("part", F.shiftright("row", 33))
    inside = pieces.withColumn("k", F.row_number().over(
        Window.partitionBy("part", "length").orderBy("row", "start")) - 1)
    sizes = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing_counts")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, capacity)

    numbered = inside.join(sizes.select("part", "length", "before"), ["part", "length"]).withColumn(
        "k", F.col("k") + F.col("before"))
    runs = np.array(plan.runs, dtype=np.int64).reshape(-1, 9)
    firsts, lasts = runs[:, 0] * SPAN + runs[:, 1], runs[:, 0] * SPAN + runs[:, 2]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key = batch["length"].to_numpy() * SPAN + batch["k"].to_numpy()
            order = np.argsort(key)
            since = np.searchsorted(key, firsts, sorter=order)
            times = np.searchsorted(key, lasts, sorter=order) - since
            met = np.flatnonzero(times)
            for some in row_ranges(times[met], ROWS):
                own, n = met[some], times[met[some]]
                part = runs[np.repeat(own, n)]
                at = order[np.repeat(since[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                step = part[:, 6] + key[at] - part[:, 0] * SPAN - part[:, 1]
                found = batch[["doc_id", "ids_crc32", "doc_tokens", "h1", "h2", "start"]].iloc[at]
                yield found.assign(
                    start=found["start"] + part[:, 3], length=part[:, 4], broken=part[:, 4] < part[:, 0],
                    sequence_id=part[:, 7] + step // part[:, 5], offset=part[:, 8] + step % part[:, 5] * part[:, 4])

    placed = materialize(numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "h1", "h2", "k").mapInPandas(
        place, f"doc_id {kind}, ids_crc32 long, doc_tokens long, h1 long, h2 long, start long, length long, broken boolean, "
               "sequence_id long, offset long"), "packing_placed")
    last = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = placed.filter("not broken").select(*last)
    parts = int((runs[:, 2] - runs[:, 1])[runs[:, 4] < runs[:, 0]].sum())
    if not parts:
        return whole

    # The ids of cut pieces are made again for the checksums of their parts, once for all copies of a text.
    broken = placed.filter("broken").drop("ids_crc32")
    wanted = broken.groupBy("h1", "h2").agg(F.collect_set(F.struct("start", "length")).alias("parts"))
    texts = rows.select("h1", "h2", "text")
    if parts <= FEW_PARTS:
        wanted = F.broadcast(wanted)
        texts = texts.join(F.broadcast(broken.select("h1", "h2").distinct()), ["h1", "h2"], "left_semi")
    texts = texts.dropDuplicates(["h1", "h2"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, parts, found = batch.column(0), batch.column(1), batch.column(2), []
            for i, raw in enumerate(encode_texts(path, cut, batch.column(3))):
                raw += tail
                found += [(i, p["start"], p["length"], zlib.crc32(raw[4 * p["start"]:4 * (p["start"] + p["length"])]))
                          for p in parts[i].as_py()]
            line, start, size, check = np.array(found, dtype=np.int64).reshape(-1, 4).T
            line = pa.array(line)
            yield pa.RecordBatch.from_arrays(
                [h1.take(line), h2.take(line), pa.array(start), pa.array(size), pa.array(check)],
                names=["h1", "h2", "start", "length", "ids_crc32"])

    checks = wanted.join(texts, ["h1", "h2"]).select("h1", "h2", "parts", "text").mapInArrow(
        tidy(check), "h1 long, h2 long, start long, length long, ids_crc32 long")
    if parts <= FEW_PARTS:
        checks = F.broadcast(checks)
    return whole.unionByName(broken.join(checks, ["h1", "h2", "start", "length"]).select(*last))
