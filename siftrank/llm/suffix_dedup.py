"""Removal of long repeats: every byte in a string of 200 bytes that also starts anywhere else.

No shard can hold the suffixes of all documents, so they are dealt out by
content.  In every window of 200 bytes the place with the smallest 64-byte hash
is its anchor: equal windows have the same anchor string, whichever documents
they are in.  Neighbouring windows with one anchor place form a segment, and
segments of equal anchor string meet in one shard.  An anchor string found once
settles its windows, and equal segments are one row with a count.

Each shard sorts the suffixes of its different segments (``suffix_arrays``) and
marks the windows whose common prefix with a neighbour is 200 bytes or more.  An
anchor string with very many different segments is split over shards; these
give their windows as sorted keys, and a merge finds by binary search those
that occur in several shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.llm.common import bound_batches, named, packed_texts, release, row_groups, text_bytes, tidy, whole_text, worker_state
from siftrank.llm.shingles import mix, powers
from siftrank.llm.suffix_arrays import common_prefixes, suffix_array
from siftrank.scratch import materialize, settled

LENGTH = 200           # bytes of a repeat
ANCHOR = 64            # bytes whose hash picks a window's anchor
GROUP_BYTES = 1 << 18  # text that is hashed at a time; longer texts go in pieces that overlap
PLACE_BITS = 22
SHARD_BYTES = 1 << 18  # segments a shard holds on average
PART_SEGMENTS = 1 << 12  # different segments of one anchor string in one shard, about a megabyte
MERGE_ROWS = 1 << 18   # window keys a merge task holds on average


class Anchors:
    """Segments of texts, with the tables of powers kept between calls."""

    def __init__(self) -> None:
        self.up, self.down = powers(GROUP_BYTES + 4 * LENGTH)

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, lo, hi, anchor hash, segment hash): window starts lo..hi of a text share an anchor."""
        n = len(data)
        starts_of = np.arange(n - LENGTH + 1) if n >= LENGTH else np.zeros(0, dtype=np.int64)
        if not len(starts_of):
            return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
        if n + 1 > len(self.up):
            self.up, self.down = powers(2 * n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * self.down[:n - ANCHOR + 1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        # Of equal hashes in a window the rightmost is taken.
        least = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
        width, have = LENGTH - ANCHOR + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        place = (low - (least & low)).astype(np.int64)
        owner = np.searchsorted(offsets, starts_of, side="right") - 1
        inside = starts_of + LENGTH <= offsets[owner + 1]
        starts_of, place, owner = starts_of[inside], place[inside], owner[inside]
        if not len(starts_of):
            return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(new)]]) - 1
        lo, end, text = starts_of[first], starts_of[last] + LENGTH, owner[first]
        whole = mix((sums[end] - sums[lo]) * self.down[lo] + (end - lo).astype(np.uint64))
        return text, lo - offsets[text], starts_of[last] - offsets[text], grams[place[first]], whole


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, first byte of each row) of at most ``GROUP_BYTES``; long texts in overlapping pieces."""
    for a, b in row_groups(offsets, GROUP_BYTES):
        if b - a == 1 and offsets[b] - offsets[a] > GROUP_BYTES:
            for at in range(0, int(offsets[b] - offsets[a]), GROUP_BYTES):
                part = data[offsets[a] + at:min(offsets[b], offsets[a] + at + GROUP_BYTES + LENGTH - 1)]
                yield part, np.array([0, len(part)]), np.array([a]), np.array([at])
        else:
            yield data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], np.arange(a, b), np.zeros(b - a, dtype=np.int64)


def anchor_rows(texts: DataFrame) -> DataFrame:
    """(cls, seg, t1, t2, lo, hi) for (t1, t2, text); more than two equal texts in a task add nothing new."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = worker_state("suffix_anchors", Anchors)
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            keep = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                seen[key] = seen.get(key, 0) + 1
                if seen[key] <= 2:
                    keep.append(i)
            batch = batch.take(pa.array(keep, pa.int64()))
            t1, t2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = text_bytes(batch.column(2))
            for part, own, rows, first in pieces_of(data, offsets):
                text, lo, hi, cls, seg = anchors.segments(part, own)
                yield pa.RecordBatch.from_arrays(
                    [signed(cls), signed(seg), pa.array(t1[rows[text]], pa.int64()), pa.array(t2[rows[text]], pa.int64()),
                     pa.array(lo + first[text], pa.int64()), pa.array(hi + first[text], pa.int64())],
                    names=["cls", "seg", "t1", "t2", "lo", "hi"])

    return texts.mapInArrow(tidy(find), "cls long, seg long, t1 long, t2 long, lo long, hi long")


def segment_bytes(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(shard, split, cls, seg, body) for (cls, seg, t1, t2, lo, hi, part, parts, shard)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for own, packed in zip(batch.column(0), batch.column(1)):
                rows = own.as_py()
                text = unpacker.decompress(packed.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"] for r in rows], pa.int64()), pa.array([r["parts"] > 1 for r in rows], pa.bool_()),
                     pa.array([r["cls"] for r in rows], pa.int64()), pa.array([r["seg"] for r in rows], pa.int64()),
                     pa.array([text[r["lo"]:r["hi"] + LENGTH] for r in rows], pa.binary())],
                    names=["shard", "split", "cls", "seg", "body"])

    # A text's own segments come together: they are bounded by its length.
    lists = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("shard", "parts", "cls", "seg", "lo", "hi")).alias("rows"))
    joined = lists.join(texts, ["t1", "t2"]).select("rows", "packed")
    return joined.mapInArrow(tidy(cut), "shard long, split boolean, cls long, seg long, body binary")


def shard_repeats(bodies: list[bytes], split: np.ndarray) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Per segment the runs of window starts that occur again in the shard (first, last, first, last, ...); and the
    windows of split segments that other shards must know, as (segment, start) in the order of their bytes."""
    size = np.array([len(b) for b in bodies], dtype=np.int64)
    data = np.frombuffer(b"\xff".join(bodies), dtype=np.uint8)  # no byte of UTF-8 text is 255
    first = np.cumsum(size + 1) - size - 1
    order = suffix_array(data)
    shared = common_prefixes(data, order)
    owner = np.searchsorted(first, order, side="right") - 1
    start = order - first[owner]
    window = start + LENGTH <= size[owner]
    above = np.concatenate([shared[1:], [0]]) >= LENGTH
    again = window & ((shared >= LENGTH) | above)
    runs: list[list[int]] = [[] for _ in bodies]
    marked = np.sort(order[again])
    if len(marked):
        whose = np.searchsorted(first, marked, side="right") - 1
        new = np.concatenate([[True], (np.diff(marked) != 1) | (np.diff(whose) != 0)])
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(marked)]]) - 1
        for seg, a, b in zip(whose[begin].tolist(), (marked[begin] - first[whose[begin]]).tolist(),
                             (marked[end] - first[whose[begin]]).tolist()):
            runs[seg] += [a, b]
    told = np.flatnonzero(window & (shared < LENGTH) & split[owner])  # the first of each group of equal windows
    return runs, list(zip(owner[told].tolist(), start[told].tolist()))


def in_shards(segments: DataFrame) -> DataFrame:
    """(cls, seg, runs, k1, k2): the marked runs of each segment, and keys of single windows of split anchors."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        bodies, split = rows["body"].tolist(), rows["split"].to_numpy()
        cls, seg = rows["cls"].to_numpy(), rows["seg"].to_numpy()
        runs, told = shard_repeats(bodies, split)
        found = [i for i, own in enumerate(runs) if own]
        digests = [hashlib.blake2b(bodies[i][at:at + LENGTH], digest_size=16).digest() for i, at in told]
        keys = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        mine = [i for i, _ in told]
        release()
        return pd.DataFrame({
            "cls": np.concatenate([cls[found], cls[mine]]).astype("int64"),
            "seg": np.concatenate([seg[found], seg[mine]]).astype("int64"),
            "runs": pd.Series([runs[i] for i in found] + [[at, at] for _, at in told], dtype=object),
            "k1": pd.array([None] * len(found) + keys[:, 0].tolist(), dtype="Int64"),
            "k2": pd.array([None] * len(found) + keys[:, 1].tolist(), dtype="Int64"),
        })

    return segments.groupBy("shard").applyInPandas(work, "cls long, seg long, runs array<bigint>, k1 long, k2 long")


def across_shards(told: DataFrame, tasks: int) -> DataFrame:
    """Windows whose key was given by several shards.  A shard gives a key once, so a key's rows are few."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.empty(len(rows), dtype=[("a", "<i8"), ("b", "<i8")])
        keys["a"], keys["b"] = rows["k1"].to_numpy(), rows["k2"].to_numpy()
        ordered = np.sort(keys)
        number = np.searchsorted(ordered, keys, side="right") - np.searchsorted(ordered, keys, side="left")
        return rows.loc[number > 1, ["cls", "seg", "runs"]]

    return told.withColumn("deal", F.pmod("k1", F.lit(tasks))).groupBy("deal").applyInPandas(
        merge, "cls long, seg long, runs array<bigint>")


def met_segments(texts: DataFrame) -> DataFrame:
    """The ``anchor_rows`` whose anchor string is found more than once, and whether all its segments are alike."""
    anchors = materialize(anchor_rows(texts), "suffix_anchors")
    classes = anchors.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high"))
    classes = classes.filter("n > 1").select("cls", (F.col("low") == F.col("high")).alias("alike"))
    classes = materialize(classes, "suffix_classes")  # so that the join can split a hot anchor's rows
    return anchors.join(classes, "cls")


def repeat_spans(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (t1, t2, text): (t1, t2, spans) of texts with repeats, and the packed texts.

    Spans are (first byte, end) pairs in one array, not yet merged.
    """
    met = settled(texts.sparkSession, "suffix_met", lambda: met_segments(texts))
    different = met.filter(~F.col("alike")).groupBy("cls", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "lo", "hi")).alias("at"))
    different = materialize(different.select("cls", "seg", "n", "at.*"), "suffix_segments")
    total = different.agg(F.sum(F.col("hi") - F.col("lo") + LENGTH)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    sizes = different.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / PART_SEGMENTS).alias("parts"))
    wanted = different.join(sizes, "cls").withColumn("part", F.pmod(F.xxhash64("seg"), F.col("parts")))
    wanted = wanted.withColumn("shard", F.pmod(F.xxhash64("cls", "part"), F.lit(shards)))
    packed = packed_texts(texts).repartition("t1", "t2").dropDuplicates(["t1", "t2"])
    marks = materialize(in_shards(segment_bytes(wanted, packed)), "suffix_marks")
    told = marks.filter("k1 is not null")
    merged = across_shards(told, max(1, -(-told.count() // MERGE_ROWS)))
    runs = marks.filter("k1 is null").select("cls", "seg", "runs").unionByName(merged)
    span = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda i: F.struct(
        F.get("runs", 2 * i).alias("a"), F.get("runs", 2 * i + 1).alias("b")))
    some = met.filter(~F.col("alike")).join(runs.withColumn("run", F.explode(span)).select("cls", "seg", "run.*"), ["cls", "seg"])
    some = some.select("t1", "t2", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b") + LENGTH).alias("b"))
    again = met.join(different.filter("n > 1").select("cls", "seg"), ["cls", "seg"], "left_semi").unionByName(met.filter("alike"))
    whole = again.select("t1", "t2", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("b"))
    spans = some.unionByName(whole).groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
    return spans.select("t1", "t2", F.flatten(F.transform("pairs", lambda p: F.array(p["a"], p["b"]))).alias("spans")), packed


def merged_spans(spans: list[int] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    found: list[list[int]] = []
    flat = spans or []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return [(a, min(b, size)) for a, b in found]


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans less the parts of characters at their ends."""
    found = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            found.append((a, b))
    return found


def rest_of(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def keyed(body: Column) -> list[Column]:
    return [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2")]


def removed(docs: DataFrame, text: str, as_text: bool) -> DataFrame:
    """(t1, t2, n_bytes, n_removed, n_spans, rest) per different text; ``rest`` is a digest or, with ``as_text``, a string."""
    bound_batches(docs)
    body = whole_text(named(docs, text))
    texts = docs.select(*keyed(body), body.alias("text"))
    spans, packed = repeat_spans(texts)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                raw = unpacker.decompress(batch.column(2)[i].as_py())
                own = merged_spans(batch.column(3)[i].as_py(), len(raw))
                if as_text:
                    own = whole_characters(raw, own)
                rest = rest_of(raw, own)
                rows.append((len(raw), len(raw) - len(rest), len(own),
                             rest.decode() if as_text else hashlib.sha256(rest).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(list(c), k) for c, k in zip(
                    columns, [pa.int64(), pa.int64(), pa.int64(), pa.string()])]],
                names=["t1", "t2", "n_bytes", "n_removed", "n_spans", "rest"])

    joined = packed.join(spans, ["t1", "t2"], "left").select("t1", "t2", "packed", "spans")
    return joined.mapInArrow(tidy(apply), "t1 long, t2 long, n_bytes long, n_removed long, n_spans long, rest string")


def repeat_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row.

    A null text is empty.  All copies of a text lose the same bytes: a text of
    200 bytes or more that occurs twice is removed whole.
    """
    rows = docs.select(named(docs, doc_id).alias("doc_id"), *keyed(whole_text(named(docs, text))))
    found = removed(docs, text, as_text=False)
    return rows.join(found, ["t1", "t2"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.col("rest").alias("kept_sha256"))


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of the text, whole characters only; a null text stays null.

    The other columns are as they were, so a column that counts characters
    tells those of the text as it came in.
    """
    own = docs.columns
    rows = docs.select(F.struct(*[named(docs, c) for c in own]).alias("row"), *keyed(whole_text(named(docs, text))),
                       named(docs, text).isNull().alias("none"))
    rows = rows.withColumn("row", F.col("row").dropFields("`" + text.replace("`", "``") + "`")) if len(own) > 1 else rows
    found = removed(docs, text, as_text=True).select("t1", "t2", "rest")
    joined = rows.join(found, ["t1", "t2"])
    field = lambda c: F.col("row").getField(c).alias(c)
    return joined.select(*[F.when(~F.col("none"), F.col("rest")).alias(c) if c == text else field(c) for c in own])
