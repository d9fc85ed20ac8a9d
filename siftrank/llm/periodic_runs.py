"""Runs of words that repeat with a period, found in tiles of a scale for each octave of periods.

A run of period q is a stretch where word i equals word i + q as far as that
goes.  One of ``EXPONENT`` periods or more has at least 3q such places i in a
row.  So for the periods from P to 2P - 1 (one octave) every run holds a place
that is a multiple of P, a centre, from which 2P words equal those q later.

1. Documents are screened octave by octave: hashes of all blocks of 2P words,
   doubled from octave to octave, show the centres and periods whose blocks
   agree.  Centres with hits become overlapping tiles, P words before and 6P
   after; neighbours share a tile.  Documents without a hit have no run and are
   finished here.
2. The tiles are dealt out anew and solved apart from each other.  At each
   centre one Z-function over the words after it and one over the reversed
   words before it give for all periods how far the repetition goes both ways.
   That is a fragment of a run; fragments of a tile are joined.
3. Fragments are shuffled by document and period, and those that overlap are
   stitched.  A run of a smaller period takes its multiples along.
4. Runs meet the words of their documents, only of documents with a hit.

A document of any length is many tiles in as many tasks; a tile holds
``TILE_WORDS`` words, or seven P where those are more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm.common import bound_batches, named, part_number, row_groups, text_bytes, tidy, whole_text
from siftrank.scratch import materialize, read_bytes

EXPONENT = 4             # periods in a run, at least
LEAST_WORDS = 6          # words in a run, at least
TILE_WORDS = 1 << 14     # words of a tile
GROUP_BYTES = 1 << 21    # texts that are screened at once
TASK_BYTES = 4 << 20     # tiles and texts on disk for one task that solves tiles
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
NOTHING = hashlib.sha256(b"").hexdigest()


class Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on equal those from the start on."""
    n = len(s)
    z = [0] * n
    first = last = 0
    for i in range(1, n):
        k = min(last - i, z[i - first]) if i < last else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > last:
            first, last = i, i + k
        z[i] = k
    return z


def screened(ids: np.ndarray, doc: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(P, centres, periods) of each octave: the blocks of 2P words at the centre and a period later have one hash.

    Of the hits of one period that follow each other every second one is
    enough: those at even multiples of P, and the first.
    """
    block = (ids.astype(np.uint64) + MIX[0]) * MIX[1] ^ (doc.astype(np.uint64) * MIX[2])
    block = (block ^ (block >> np.uint64(31))) * MIX[0]
    size = 1
    while EXPONENT * size <= longest:
        block = block[:-size] * MIX[size.bit_length() % 3] + block[size:]
        lines = np.concatenate([block, np.zeros(-len(block) % size, dtype=np.uint64)]).reshape(-1, size)
        line, column = np.nonzero(lines[1:] == lines[:-1, :1])
        centre, period = line * size, column + size
        real = centre + period < len(block)
        real[real] = doc[centre[real]] == doc[centre[real] + period[real]]
        line, column, centre, period = line[real], column[real], centre[real], period[real]
        place = line * size + column  # ascending; the hit before has the same column in the line before
        before = np.searchsorted(place, place - size)
        keep = line % 2 == 0
        keep |= place[np.minimum(before, len(place) - 1)] != place - size
        yield size, centre[keep], period[keep]
        size *= 2


def tiles_of(size: int, centre: np.ndarray, period: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[tuple]:
    """(document, first word, end, centres, where each centre's periods start, periods) of tiles; centres lie side by side in each."""
    own, first = np.unique(centre, return_index=True)
    bounds = np.append(first, len(centre))
    apart = np.flatnonzero((np.diff(own) > 2 * size) | (np.diff(doc[own]) != 0)) + 1
    most = max(1, TILE_WORDS // (2 * size))
    for a, b in zip([0, *apart], [*apart, len(own)]):
        for c in range(a, b, most):
            d = min(c + most, b)
            number = doc[own[c]]
            lo, hi = max(start[number], own[c] - size), min(start[number + 1], own[d - 1] + 6 * size)
            yield int(number), int(lo), int(hi), own[c:d], bounds[c:d + 1] - bounds[c], period[bounds[c]:bounds[d]]


def smallest_period(words: list[int]) -> int:
    z = z_function(words)
    return next((p for p in range(1, len(words)) if z[p] == len(words) - p), len(words))


def fragments(words: list[int], at: int, size: int, centres: list[int], bounds: list[int], periods: list[int]) -> Iterator[tuple]:
    """(period, first, last) for the places where word i equals word i + period, of runs that touch the tile.

    ``words`` are those from ``at`` on of a document, where places are counted.
    What no other tile sees a part of, and is no run, is left out.
    """
    now: dict[int, list[int]] = {}
    done: list[tuple[int, int, int]] = []
    for k, centre in enumerate(centres):
        c = centre - at
        ahead = z_function(words[c:c + 6 * size])
        before = words[max(0, c - size):c][::-1]
        end = min(c + 2 * size - 1, len(words))
        back = z_function([*before, -1, *words[max(0, c - size):end][::-1]])
        for q in periods[bounds[k]:bounds[k + 1]]:
            right = min(ahead[q], 4 * size)
            if not right:
                continue
            left = back[len(before) + 1 + end - c - q] if before else 0
            first, last = centre - left, centre + right
            if q in now and first <= now[q][1]:
                now[q][1] = max(last, now[q][1])
            else:
                if q in now:
                    done.append((q, *now[q]))
                now[q] = [first, last]
    done += [(q, *span) for q, span in now.items()]
    least: dict[tuple[int, int], int] = {}
    for q, first, last in done:
        # Whole here and seen by no other tile: the next centres on both sides lie outside.
        if first > centres[0] - size and last < centres[-1] + 3 * size:
            end = last + q
            if end - first < max(LEAST_WORDS, EXPONENT * q):
                continue
            if (first, end) not in least:
                least[first, end] = smallest_period(words[first - at:end - at])
            if least[first, end] < q:
                continue
        yield q, first, last


def finish(words: list[bytes], runs: list[tuple[int, int, int]], digest: bool) -> tuple:
    """What a document's row says of its runs (start, length, period), and the text without their repetitions."""
    drop = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        drop[start + period:start + length] = True
    left = b" ".join([w for w, gone in zip(words, drop.tolist()) if not gone])
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    about = (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2])
    if digest:
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        return *about, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()
    return *about, [{"start": s, "length": n, "period": p} for s, n, p in runs], left.decode()


PARTS = "row long, doc_id {id}, packed binary, done string, size long, at long, words binary, centres binary, bounds binary, periods binary"


def cut_documents(rows: DataFrame, digest: bool) -> DataFrame:
    """One row per document and one per tile (with ``size``), the numbers of words and places as binary lists."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = PARTS.format(id=kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        row = part_number() << 33
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for first, last in row_groups(offsets, GROUP_BYTES):
                own = [data[a:b].tobytes().split() for a, b in zip(offsets[first:last], offsets[first + 1:last + 1])]
                sizes = np.array([len(w) for w in own])
                start = np.concatenate([[0], np.cumsum(sizes)])
                doc = np.repeat(np.arange(len(own)), sizes)
                numbers = Numbers()
                ids = np.fromiter((numbers[w] for words in own for w in words), np.int32, int(start[-1]))
                tiles = []
                for size, centre, period in screened(ids, doc, int(sizes.max(initial=0))):
                    if len(centre):
                        tiles += [(size, *tile) for tile in tiles_of(size, centre, period, doc, start)]
                hit = {tile[1] for tile in tiles}
                packed, done = [], []
                for number, words in enumerate(own):
                    whole = b" ".join(words)
                    packed.append(packer.compress(whole) if number in hit else None)
                    done.append(None if number in hit else hashlib.sha256(whole).hexdigest() if digest else whole.decode())
                names = [row + i for i in range(len(own))]
                none = [None] * len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), batch.column(0).slice(first, last - first),
                     pa.array(packed, pa.binary()), pa.array(done, pa.string()), pa.array(none, pa.int64()), pa.array(none, pa.int64()),
                     *[pa.array(none, pa.binary())] * 4],
                    names=[c.split()[0] for c in shape.split(", ")])
                for some in [tiles[i:i + 256] for i in range(0, len(tiles), 256)]:
                    none = [None] * len(some)
                    base = [int(start[t[1]]) for t in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row + t[1] for t in some], pa.int64()), pa.nulls(len(some), batch.schema.field(0).type),
                         pa.array(none, pa.binary()), pa.array(none, pa.string()),
                         pa.array([t[0] for t in some], pa.int64()), pa.array([t[2] - b for t, b in zip(some, base)], pa.int64()),
                         pa.array([ids[t[2]:t[3]].tobytes() for t in some], pa.binary()),
                         pa.array([(t[4] - b).astype(np.int64).tobytes() for t, b in zip(some, base)], pa.binary()),
                         pa.array([t[5].astype(np.int64).tobytes() for t in some], pa.binary()),
                         pa.array([t[6].astype(np.int64).tobytes() for t in some], pa.binary())],
                        names=[c.split()[0] for c in shape.split(", ")])
                row += len(own)

    return rows.mapInArrow(tidy(cut), shape)


def solve_tiles(tiles: DataFrame) -> DataFrame:
    """(row, period, first, last) of the fragments of all tiles."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            for i in range(batch.num_rows):
                row, size, at = (batch.column(k)[i].as_py() for k in range(3))
                words = np.frombuffer(batch.column(3)[i].as_buffer(), np.int32).tolist()
                centres, bounds, periods = (np.frombuffer(batch.column(k)[i].as_buffer(), np.int64).tolist() for k in (4, 5, 6))
                found += [(row, *f) for f in fragments(words, at, size, centres, bounds, periods)]
            table = np.array(found, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(4)], names=["row", "period", "first", "last"])

    return tiles.select("row", "size", "at", "words", "centres", "bounds", "periods").mapInArrow(
        tidy(solve), "row long, period long, first long, last long")


def stitch(found: DataFrame) -> DataFrame:
    """(row, start, length, period): overlapping fragments of a document and period as one, and of equal stretches the smallest period."""
    line = Window.partitionBy("row", "period").orderBy("first", "last")
    reach = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    pieces = found.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1))
    pieces = pieces.withColumn("piece", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = pieces.groupBy("row", "period", "piece").agg(F.min("first").alias("start"), F.max("last").alias("last"))
    spans = spans.withColumn("length", F.col("last") + F.col("period") - F.col("start"))
    spans = spans.filter((F.col("length") >= LEAST_WORDS) & (F.col("length") >= EXPONENT * F.col("period")))
    return spans.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def collapse_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """The runs of each whole text and the text without their repetitions.

    Words are what lies between white space of ASCII.  A run is a stretch of
    words with smallest period q, of 4q and six words at least, that no word
    beside it extends with this period; its first q words stay, and a word that
    is a repetition in any run goes.  Columns: ``doc_id``, ``n_runs``; ``start``,
    ``length``, ``period`` and ``exponent_milli`` of the run with the most
    periods (ties: the first, then the shortest period; null without a run);
    ``runs`` by start and period, and ``collapsed``, the kept words joined by
    spaces.  With ``digest`` the last two are ``runs_sha256`` (of the lines
    ``start,length,period``) and ``collapsed_sha256``.

    A null text has no words and so no run; repeated rows and null ids have rows
    of their own; an empty table gives none; other columns are left out.
    """
    bound_batches(docs)
    rows = docs.select(named(docs, doc_id).alias("doc_id"), whole_text(named(docs, text)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = materialize(cut_documents(rows, digest), "run_tiles")
    tiles = parts.filter("size is not null")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, read_bytes(parts) // TASK_BYTES)
    tiles = tiles.repartition(tasks, "row", "size", "at")
    runs = stitch(solve_tiles(tiles)).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("found"))
    texts = parts.filter("packed is not null").select("row", "doc_id", "packed").join(runs, "row", "left").select("doc_id", "packed", "found")
    tail = "runs_sha256 string, collapsed_sha256 string" if digest else "runs array<struct<start: long, length: long, period: long>>, collapsed string"
    out = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, {tail}"

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        shape = [pa.int64()] * 5 + ([pa.string()] if digest else [pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))])
        for batch in batches:
            lines = []
            for i in range(batch.num_rows):
                runs = sorted(((r["start"], r["length"], r["period"]) for r in batch.column(2)[i].as_py() or []), key=lambda r: (r[0], r[2]))
                lines.append(finish(unpacker.decompress(batch.column(1)[i].as_py()).split(), runs, digest))
            columns = list(zip(*lines)) if lines else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, [*shape, pa.string()])]],
                names=[c.split()[0] for c in out.split(", ")[:6]] + (["runs_sha256", "collapsed_sha256"] if digest else ["runs", "collapsed"]))

    none = F.lit(None).cast("long")
    empty = F.lit(NOTHING) if digest else F.array().cast("array<struct<start: long, length: long, period: long>>")
    calm = parts.filter("done is not null").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *[none.alias(c) for c in ("start", "length", "period", "exponent_milli")],
        empty.alias("runs_sha256" if digest else "runs"), F.col("done").alias("collapsed_sha256" if digest else "collapsed"))
    return calm.unionByName(texts.mapInArrow(tidy(collapse), out))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document with a repetition planted by its id, in one of ten."""
    mark = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), mark // 10
    if mark % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def plant_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): one document in ten with a planted repetition, to try the operator on; rows with a null id have none."""
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b" ".join(planted(t.encode().split(), i)).decode() if i is not None and zlib.crc32(str(i).encode()) % 10 == 0 else t
                     for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    bound_batches(docs)
    rows = docs.select(named(docs, doc_id).alias("doc_id"), whole_text(named(docs, text)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(plant), f"doc_id {kind}, text string")
