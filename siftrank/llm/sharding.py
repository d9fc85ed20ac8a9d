"""Shards of near-equal bytes by sampled splitters.

Records are ordered by a key (hash of the text, hash of the id, a row number),
so equal texts stay side by side.  Keys are drawn with a chance that grows with
the record's size; their quantiles cut the key space into many fine ranges, the
ranges are counted exactly, and a range that holds too much is cut again by
keys drawn inside it, until none is overfull; a record larger than a range is
one by itself.  Shards are runs of fine ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm.common import named, whole_text, wider
from siftrank.scratch import materialize

RANGES_PER_SHARD = 128  # fine ranges a shard is made of, at least
ROWS_PER_RANGE = 1 << 18  # rows a fine range may hold on average
KEYS_PER_RANGE = 8      # keys drawn for each range
ROUNDS = 20             # counts at most; each cuts overfull ranges in two or more, by keys drawn anew

KEY = np.dtype([("a", ">u8"), ("b", ">u8"), ("c", ">u8")])


def keys_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Comparable 24-byte keys of three signed numbers."""
    out = np.empty(len(a), dtype=KEY)
    for name, part in zip("abc", (a, b, c)):
        out[name] = part.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("V24").reshape(-1)


def place(splitters: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Range of each key: the number of splitters at or below it."""
    if not len(splitters):
        return np.zeros(len(keys), dtype=np.int64)
    # Python's bytes compare byte by byte, as numpy's fixed-width bytes do.
    return np.searchsorted(splitters.view("S24"), keys.view("S24"), side="right")


def in_ranges(records: DataFrame, splitters: np.ndarray) -> DataFrame:
    """``records`` with the number of the range that holds the key."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place(splitters, keys_of(a, b, c)), pa.int64())],
                names=[*batch.schema.names, "range"])

    order = ["k1", "k2", "k3", *[c for c in records.columns if c not in ("k1", "k2", "k3")]]
    ordered = records.select(*order)
    return ordered.mapInArrow(find, wider(ordered, range="long"))


def after(keys: np.ndarray) -> np.ndarray:
    """The next key after each."""
    following = [(int.from_bytes(k, "big") + 1).to_bytes(25, "big")[1:] for k in (bytes(x) for x in keys)]
    return np.array(following, dtype="V24") if following else keys


def draw(records: DataFrame, n: int, total: int, turn: int = 0) -> list:
    """About ``n`` keys, each record drawn with a weight of its size; the same on every run, and others in each turn.

    Each record waits for a time that is exponential at the rate of its size, and
    the first ones are taken.  Of ``total`` bytes about ``3 * n`` come before the
    limit, so a task sends its share only.
    """
    chance = (F.xxhash64("k1", "k2", "k3", F.lit(7 + turn)).cast("double") / float(1 << 64)) + 0.5
    wait = -F.log(F.greatest(chance, F.lit(1e-18))) / F.col("size")
    early = records.withColumn("wait", wait).filter(F.col("wait") <= 3 * n / total)
    return early.orderBy("wait", "k1", "k2", "k3").select("k1", "k2", "k3").limit(n).collect()


def sampled_ranges(records: DataFrame, shards: int) -> tuple[np.ndarray, list]:
    """Splitters, and (range, bytes, rows) of every fine range in order."""
    rows, total = records.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not rows:
        return np.zeros(0, dtype="V24"), []
    wanted = shards * max(RANGES_PER_SHARD, math.ceil(rows / ROWS_PER_RANGE / shards))
    most = total / wanted * 2

    def keys(drawn: list) -> np.ndarray:
        parts = np.array([tuple(r) for r in drawn], dtype=np.int64).reshape(-1, 3)
        return np.unique(keys_of(parts[:, 0], parts[:, 1], parts[:, 2]).view("S24")).view("V24")

    def joined(*some: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate(some).view("S24")).view("V24")

    drawn = keys(draw(records, wanted * KEYS_PER_RANGE, total))
    splitters = drawn[np.unique(np.arange(1, wanted) * len(drawn) // wanted)]
    # A record larger than a range is one by itself, cut off on both sides; there are fewer of them than ranges.
    large = keys(records.filter(F.col("size") > most).select("k1", "k2", "k3").collect())
    splitters = joined(splitters, large, after(large))
    for turn in range(1, ROUNDS + 1):
        ranged = in_ranges(records, splitters)
        counted = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).orderBy("range").collect()
        over = {r["range"]: r["bytes"] for r in counted if r["bytes"] > most and r["rows"] > 1}
        if not over or turn == ROUNDS:  # the last count is that of the last splitters
            break
        needed = sum(math.ceil(size / most) for size in over.values())
        more = keys(draw(ranged.filter(F.col("range").isin(list(over))), needed * KEYS_PER_RANGE, sum(over.values()), turn))
        at = place(splitters, more)
        new = [splitters]
        for number, size in over.items():
            own, parts = more[at == number], math.ceil(size / most) + 1
            if len(own):
                new.append(own[np.unique(np.arange(1, parts) * len(own) // parts)])
        splitters = joined(*new)
    return splitters, [(r["range"], r["bytes"], r["rows"]) for r in counted]


def assign_shards(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``bytes``: the shards' sizes differ by less than two fine ranges, or by
    one record where that is larger.  Equal texts lie side by side and are parted
    only by the end of a shard.  A null text has size 1 and checksum 0; rows that
    are wholly equal are told apart by their place in the input; an empty table
    gives no rows.
    """
    body = whole_text(named(docs, text))
    records = docs.select(
        F.xxhash64(body).alias("k1"), F.xxhash64(named(docs, doc_id)).alias("k2"),
        F.monotonically_increasing_id().alias("k3"), named(docs, doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    records = materialize(records, "shard_records")
    splitters, counted = sampled_ranges(records, shards)
    total = sum(size for _, size, _ in counted) or 1
    where, before, slots = [], 0, [0] * shards
    for number, size, rows in counted:
        shard = min(shards - 1, int((before + size / 2) * shards // total))
        where.append((number, shard, slots[shard]))
        slots[shard] += rows
        before += size
    ranges = docs.sparkSession.createDataFrame(where, "range long, shard int, first long")  # one row per fine range
    inside = Window.partitionBy("range").orderBy("k1", "k2", "k3")
    return in_ranges(records, splitters).withColumn("slot", F.row_number().over(inside) - 1).join(ranges, "range").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("slot") + F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
