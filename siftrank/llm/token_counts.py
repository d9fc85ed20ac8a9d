"""Token counts by a map-side lookup in two tiers: no pre-token is ever shuffled.

The texts are read twice, and stay in the tasks that read them.

1. Each task sums its pre-tokens up in a sketch of bounded size (Misra-Gries:
   whatever makes up more than one in ``FREQUENT`` pre-tokens is in it), and
   the sketches are merged in groups until one is left.
2. The lengths of its pre-tokens go to all executors as a compact hash table
   of at most ``FREQUENT`` entries, some 3 MB whatever the input.  A pre-token
   of up to 15 bytes is its own key of 128 bits, so a hit is exact.  All
   pre-tokens of a batch are looked up at once; a miss goes to the worker's
   dictionary of bounded size, and to the tokenizer's model if it is not there.

Pre-tokens are found in whole batches of UTF-8 bytes by the class of each
character.  The classes are asked of the tokenizer's own pre-tokenizer, so they
are those of its Unicode version.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.llm.common import bound_batches, merged_state, named, row_groups, text_bytes, tidy, whole_text, worker_state
from siftrank.llm.token_ids import byte_letters

FREQUENT = 1 << 15      # entries of a sketch and of the table
SLOTS_BITS = 17         # slots of the table: a quarter is in use at most
KEY_BYTES = 15          # longest pre-token that is a key of its own
GROUP_BYTES = 1 << 20   # texts that are cut at once
CACHE_PIECES = 400_000  # misses a worker remembers; it then starts anew
CACHED_BYTES = 64       # longer misses are not remembered

SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)
SKETCH = np.dtype([("lo", "<u8"), ("hi", "<u8"), ("n", "<i8")])
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def read_tokenizer(path: str):
    """The tokenizer and its added strings; it must cut texts by the byte-level pattern and change nothing else in them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        form = json.load(file)
    cut = form.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    added = form.get("added_tokens") or []
    if not plain or form.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("token_counts takes byte-level tokenizers without a normalizer")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    return tokenizer, [t["content"] for t in added]


@lru_cache(maxsize=4)
def character_classes(path: str) -> np.ndarray:
    """Class of every code point: two characters of one class are not parted by the pre-tokenizer.

    All code points in a row fall into runs of one class; the first of each run
    is tried beside a letter, a digit and a mark of known class.
    """
    cutter = read_tokenizer(path)[0].pre_tokenizer
    points = np.array([p for p in range(0x80, 0x110000) if not 0xD800 <= p < 0xE000])
    runs = [(p, p + 1) for p in range(0x80)]
    for first in range(0, len(points), 1 << 16):
        some = points[first:first + (1 << 16)]
        runs += [(some[a], some[b - 1] + 1) for _, (a, b) in cutter.pre_tokenize_str("".join(map(chr, some)))]
    kinds = np.full(len(runs), WHITE, dtype=np.uint8)
    for mark, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
        text = "".join(["\n" + mark + chr(first) for first, _ in runs])
        parted = np.zeros(len(text), dtype=bool)
        parted[[start for _, (start, _) in cutter.pre_tokenize_str(text)]] = True
        kinds[~parted[2::3]] = kind
    classes = np.full(0x110000, WHITE, dtype=np.uint8)
    for (first, last), kind in zip(runs, kinds):
        classes[first:last] = kind
    classes[ord(" ")] = SPACE
    return classes


def character_kinds(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    kinds = classes[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.int32)
        own = [padded[lead + i] & 0x3F for i in range(4)]
        width = 2 + (padded[lead] >= 0xE0) + (padded[lead] >= 0xF0)
        point = np.select(
            [width == 2, width == 3],
            [(own[0] & 0x1F) << 6 | own[1], (own[0] & 0x0F) << 12 | own[1] << 6 | own[2]],
            (own[0] & 0x07) << 18 | own[1] << 12 | own[2] << 6 | own[3])
        found = classes[point]
        for i in range(4):
            some = width > i
            kinds[lead[some] + i] = found[some]
    return kinds


def piece_starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, added: list[str]) -> np.ndarray:
    """Where the pre-tokens of texts that lie one after another start, in order.  An added string is one pre-token."""
    n = len(data)
    edge = np.zeros(n + 4, dtype=bool)  # no pre-token crosses the start of a text
    edge[offsets] = True
    strings = []
    for first, last in added_strings(data, offsets, added):
        strings.append((first, last))
        edge[[first, last]] = True
    kinds = character_kinds(data, classes)
    groups = np.maximum(kinds, WHITE)
    start = edge[:n].copy()
    start[1:] |= groups[1:] != groups[:-1]
    # The last of several blanks goes with what follows: a space as its first character, another one by itself.
    after = np.flatnonzero(start[1:] & (groups[1:] != WHITE) & (groups[:-1] == WHITE) & ~edge[1:n]) + 1
    last = after - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    start[after[kinds[last] == SPACE]] = False
    # 's 't 'm 'd 're 've 'll are pre-tokens where an apostrophe starts one.
    quote = np.flatnonzero(start & (data == ord("'")))
    padded = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)) & ~edge[quote + 1]
    pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    long = pair & ~edge[quote + 1] & ~edge[quote + 2]
    for which, size in ((short, 2), (long, 3)):
        start[quote[which] + 1] = False
        ends = quote[which] + size
        start[ends[ends < n]] = True
    for first, last in strings:
        start[first + 1:last] = False
    return np.flatnonzero(start)


def added_strings(data: np.ndarray, offsets: np.ndarray, added: list[str]) -> Iterator[tuple[int, int]]:
    """(first, last) of each added string, the leftmost and then the longest ones, inside a text."""
    if not added:
        return
    raw = data.tobytes()
    marks = [a.encode() for a in added]
    if not any(m in raw for m in marks):
        return
    wanted = re.compile(b"|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)))
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        for hit in wanted.finditer(raw, first, last):
            yield hit.span()


def piece_keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first eight bytes, the next seven with the length on top, and the length of each pre-token."""
    sizes = np.diff(np.append(starts, len(data)))
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded, (len(data) + 9, 8), (1, 1))
    lo = np.ascontiguousarray(eights[starts]).view("<u8").ravel() & MASKS[np.minimum(sizes, 8)]
    hi = np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56)
    more = np.flatnonzero(sizes > 8)
    hi[more] |= np.ascontiguousarray(eights[starts[more] + 8]).view("<u8").ravel() & MASKS[np.minimum(sizes[more] - 8, 7)]
    return lo, hi, sizes


def mixed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    value = (lo * MIX[0]) ^ ((hi + MIX[2]) * MIX[1])
    value = (value ^ (value >> np.uint64(32))) * MIX[2]
    return value ^ (value >> np.uint64(29))


class Sketch:
    """Counts of frequent pre-tokens; only too low, by at most one in ``limit`` of all that were added."""

    def __init__(self, limit: int = FREQUENT) -> None:
        self.limit = limit
        self.rows = np.zeros(0, dtype=SKETCH)
        self.marks = np.zeros(0, dtype=np.uint64)

    def add(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> None:
        rows = np.zeros(len(lo), dtype=SKETCH)
        rows["lo"], rows["hi"], rows["n"] = lo, hi, n
        marks = np.concatenate([self.marks, mixed(lo, hi)])
        rows = np.concatenate([self.rows, rows])
        self.marks, first, back = np.unique(marks, return_index=True, return_inverse=True)
        counts = np.bincount(back, rows["n"], len(first)).astype(np.int64)
        self.rows = rows[first]
        self.rows["n"] = counts
        if len(counts) > 4 * self.limit:
            self.trim()

    def trim(self) -> None:
        if len(self.rows) > self.limit:
            counts = self.rows["n"]
            least = np.partition(counts, len(counts) - self.limit - 1)[len(counts) - self.limit - 1]
            keep = counts > least
            self.rows, self.marks = self.rows[keep], self.marks[keep]
            self.rows["n"] -= least

    def dump(self) -> bytes:
        self.trim()
        return self.rows.tobytes()

    def merge(self, raw: bytes) -> None:
        rows = np.frombuffer(raw, dtype=SKETCH)
        self.add(rows["lo"], rows["hi"], rows["n"])


def frequent_pieces(rows: DataFrame, path: str, limit: int = FREQUENT) -> list[bytes]:
    """The frequent pre-tokens of all texts (the last column), at most ``limit`` of them."""
    classes, added = character_classes(path), read_tokenizer(path)[1]
    send = rows.sparkSession.sparkContext.broadcast(classes)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> bytes:
        sketch = Sketch(limit)
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for first, last in row_groups(offsets, GROUP_BYTES):
                some = data[offsets[first]:offsets[last]]
                starts = piece_starts(some, offsets[first:last + 1] - offsets[first], send.value, added)
                lo, hi, sizes = piece_keys(some, starts)
                fit = sizes <= KEY_BYTES
                lo, hi = lo[fit], hi[fit]
                _, at, n = np.unique(mixed(lo, hi), return_index=True, return_counts=True)
                sketch.add(lo[at], hi[at], n)
        return sketch.dump()

    def merge(states: list[bytes]) -> bytes:
        sketch = Sketch(limit)
        for state in states:
            sketch.merge(state)
        return sketch.dump()

    state = merged_state(rows, sum_up, merge, "piece_sketches")
    found = np.frombuffer(state or b"", dtype=SKETCH)
    raw = found["lo"].astype("<u8").tobytes(), found["hi"].astype("<u8").tobytes()
    return [(raw[0][i:i + 8] + raw[1][i:i + 7])[:raw[1][i + 7]] for i in range(0, len(raw[0]), 8)]


class LengthTable:
    """Numbers of tokens of pre-tokens of up to 15 bytes, in open addressing."""

    def __init__(self, pieces: list[bytes], lengths: list[int], bits: int = SLOTS_BITS) -> None:
        self.bits = bits
        self.lo, self.hi = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
        self.length = np.zeros(1 << bits, dtype=np.int32)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        starts = np.cumsum([0, *map(len, pieces)])[:-1].astype(np.int64)
        lo, hi, _ = piece_keys(data, starts)
        for a, b, at, n in zip(lo, hi, self.slots(lo, hi).tolist(), lengths):
            while self.hi[at]:
                at = (at + 1) % len(self.hi)
            self.lo[at], self.hi[at], self.length[at] = a, b, n

    def slots(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (mixed(lo, hi) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Number of tokens, -1 for what is not in the table."""
        found = np.full(len(lo), -1, dtype=np.int64)
        left, at = np.arange(len(lo)), self.slots(lo, hi)
        while len(left):
            same = (self.lo[at] == lo[left]) & (self.hi[at] == hi[left])
            found[left[same]] = self.length[at[same]]
            on = ~same & (self.hi[at] != 0)
            left, at = left[on], (at[on] + 1) & (len(self.hi) - 1)
        return found


class MissCounter(dict):
    """Number of tokens of a pre-token, asked of the tokenizer's model once per worker."""

    def __init__(self, path: str) -> None:
        super().__init__()
        tokenizer, added = read_tokenizer(path)
        self.model, self.letters = tokenizer.model, byte_letters()
        self.added = {a.encode() for a in added}

    def __missing__(self, piece: bytes) -> int:
        n = 1 if piece in self.added else len(self.model.tokenize(piece.decode("latin-1").translate(self.letters)))
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = n
        return n


def count_batch(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, table: LengthTable, misses: MissCounter,
                added: list[str]) -> np.ndarray:
    """Tokens of each text."""
    starts = piece_starts(data, offsets, classes, added)
    lo, hi, sizes = piece_keys(data, starts)
    found = np.where(sizes <= KEY_BYTES, table.find(lo, hi), -1)
    missed = np.flatnonzero(found < 0)
    raw = data.tobytes()
    found[missed] = [misses[raw[a:b]] for a, b in zip(starts[missed].tolist(), (starts + sizes)[missed].tolist())]
    before = np.concatenate([[0], np.cumsum(found)])
    return np.diff(before[np.searchsorted(starts, offsets)])


def token_counts(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text",
                 frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row: the tokens its whole text has under a byte-level tokenizer.

    The counts are those of the library's ``encode`` without special tokens;
    an added string inside a text, such as an end mark, is one token.
    ``over_limit`` is true for more than ``limit`` tokens.  A null or empty text
    has no byte and no token; a null id stays null, repeated rows are counted
    each, and an empty table gives no rows.  Other columns are left out.
    """
    bound_batches(docs)
    rows = docs.select(named(docs, doc_id).alias("doc_id"), whole_text(named(docs, text)).alias("text"))
    pieces = frequent_pieces(rows.select("text"), path, min(frequent, FREQUENT))
    counter = MissCounter(path)
    classes, added = character_classes(path), sorted(a.decode() for a in counter.added)
    send = rows.sparkSession.sparkContext.broadcast((classes, LengthTable(pieces, [counter[p] for p in pieces])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = send.value
        misses = worker_state(f"miss_counter {path}", lambda: MissCounter(path))
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            numbers = [np.zeros(0, dtype=np.int64)]
            for first, last in row_groups(offsets, GROUP_BYTES):
                some = data[offsets[first]:offsets[last]]
                numbers.append(count_batch(some, offsets[first:last + 1] - offsets[first], own, table, misses, added))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(np.concatenate(numbers), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(tidy(count), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
