"""Token ids in binary files: canonical length-limited Huffman codes in independent blocks.

A file is a header, blocks one after another, and nothing else; the manifest
(a table, one row per block) says where each block lies.  A block holds whole
documents: their ids as one bit string, cut into lanes of ``LANE`` ids whose
bit offsets are stored, so that all lanes are decoded side by side through one
table.  Code lengths come from the counts of all ids of all documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm.common import bound_batches, named, open_store, shared_folder, task_name, tidy, whole_text, write_shared
from siftrank.llm.token_ids import encode_texts
from siftrank.scratch import materialize

MAGIC = b"HUFIDS01"
LANE = 128             # ids between two stored bit offsets
BLOCK_IDS = 1 << 18    # a block is closed once it has so many ids
FILE_IDS = 1 << 23     # ids a file is meant to hold
MAX_BITS = 16          # longest code, raised only if there are more ids than codes of this length


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for ids that do not occur.

    The limit is raised to the least possible one when there are too many ids for it.
    """
    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    packages = np.zeros(0)
    levels = []
    for _ in range(max_bits):
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        levels.append(np.cumsum(place < len(leaves)))  # leaves among the first items of the level
        merged = both[place]
        merged = merged[:len(merged) // 2 * 2]
        packages = merged[0::2] + merged[1::2]
    depth = np.zeros(len(order), dtype=np.int64)
    take = 2 * (len(order) - 1)
    for level in reversed(levels):
        if take == 0:
            break
        own = int(level[take - 1])
        depth[:own] += 1
        take = 2 * (take - own)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), dtype=np.uint64)
    if len(order):
        top = int(lengths[order[-1]])
        steps = np.uint64(1) << (np.uint64(top) - lengths[order].astype(np.uint64))
        starts = np.cumsum(steps) - steps
        codes[order] = starts >> (np.uint64(top) - lengths[order].astype(np.uint64))
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every bit string of the longest code's length: the id and its code's length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    bits = int(lengths.max(initial=1))
    width = np.int64(1) << (bits - lengths[order].astype(np.int64))
    ids = np.zeros(1 << bits, dtype=np.uint32)
    sizes = np.ones(1 << bits, dtype=np.int64)
    total = int(width.sum())
    ids[:total] = np.repeat(order.astype(np.uint32), width)
    sizes[:total] = np.repeat(lengths[order].astype(np.int64), width)
    return ids, sizes, bits


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit string of the ids' codes, first bit first, and the bit offset of every lane."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 2, dtype=np.uint64)
    if len(ids):
        code = codes[ids]
        word = at >> 6
        over = (at & 63) + size - 64  # bits that reach into the next word
        left = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(left, first)
        spill = np.flatnonzero(over > 0)
        words[word[spill] + 1] |= code[spill] << (64 - over[spill]).astype(np.uint64)
    return words.astype(">u8").tobytes()[:(total + 7) // 8], at[::LANE]


def unpack_bits(bits: np.ndarray, lanes: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Ids of a bit string; all lanes advance together by one table look-up per id."""
    ids, sizes, width = table
    padded = np.concatenate([bits, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    windows = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    out = np.zeros((LANE, len(lanes)), dtype=np.uint32)
    at = lanes.astype(np.int64)
    last, down = len(windows) - 1, np.uint32(32 - width)
    for step in range(min(LANE, n)):
        window = windows[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)
        window >>= down
        out[step] = ids[window]
        at = at + sizes[window]
    return out.T.reshape(-1)[:n]


def block_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, codes: np.ndarray,
                lengths: np.ndarray) -> bytes:
    bits, lanes = pack_bits(ids, codes, lengths)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    values = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join([
        struct.pack("<QQQ", len(doc_ids), len(ids), len(bits)), known.tobytes(), values.tobytes(),
        counts.astype("<i8").tobytes(), lanes.astype("<u8").tobytes(), bits,
    ])


def read_block(raw: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of a block."""
    docs, n, size = struct.unpack_from("<QQQ", raw)
    at = 24
    known = np.frombuffer(raw, dtype=np.uint8, count=docs, offset=at)
    at += docs
    values = np.frombuffer(raw, dtype="<i8", count=docs, offset=at)
    at += 8 * docs
    counts = np.frombuffer(raw, dtype="<i8", count=docs, offset=at)
    at += 8 * docs
    n_lanes = -(-n // LANE)
    lanes = np.frombuffer(raw, dtype="<u8", count=n_lanes, offset=at)
    at += 8 * n_lanes
    bits = np.frombuffer(raw, dtype=np.uint8, count=size, offset=at)
    ids = unpack_bits(bits, lanes, n, table)
    return [int(v) if k else None for v, k in zip(values, known)], counts, ids


def header(lengths: np.ndarray) -> bytes:
    table = zlib.compress(lengths.tobytes())
    return MAGIC + struct.pack("<QQ", len(lengths), len(table)) + table


def read_header(stream) -> np.ndarray:
    stream.seek(0)
    start = stream.read(24)
    if start[:8] != MAGIC:
        raise ValueError("not a file of coded ids")
    _, size = struct.unpack("<QQ", start[8:])
    return np.frombuffer(zlib.decompress(stream.read(size)), dtype=np.uint8)


def squeeze(ids: np.ndarray) -> bytes:
    """Ids as a small byte string for rows that travel: planes of bytes, compressed."""
    import zstandard

    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(raw: bytes) -> np.ndarray:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(raw)
    planes = np.frombuffer(data, dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def tokenize(docs: DataFrame, path: str, cut: str = "words", end_id: int | None = 1, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """Rows (doc_id, tie, n_tokens, ids): the squeezed ids of each whole text and the end id.

    ``tie`` tells rows of equal document id apart.  A null text is empty; a
    null document id stays null and sorts first.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        for batch in batches:
            sizes, packed = [], []
            for raw in encode_texts(path, cut, batch.column(2)):
                ids = np.frombuffer(raw + tail, dtype="<u4")
                sizes.append(len(ids))
                packed.append(squeeze(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "tie", "n_tokens", "ids"])

    bound_batches(docs)
    rows = docs.select(named(docs, doc_id).cast("long").alias("doc_id"),
                       F.monotonically_increasing_id().alias("tie"), whole_text(named(docs, text)).alias("text"))
    return rows.mapInArrow(tidy(encode), "doc_id long, tie long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; as long as the largest id, whatever the input."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = np.bincount(unsqueeze(raw))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), dtype=np.int64)])
                total[:len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())],
                                         names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(tidy(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, dtype=np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def write_ids(tokens: DataFrame, folder: str, file_ids: int = FILE_IDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Write the ids in ascending order of document id and give the manifest, one row per block.

    ``tokens`` is a written table of ``tokenize``.  A task that is run again
    writes files of another name; the manifest names those that count.
    """
    lengths = code_lengths(id_counts(tokens), max_bits)
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    files = max(1, -(-total // file_ids))
    codes = canonical_codes(lengths)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = header(lengths)
        path = f"{folder}/{task_name('ids', '.huf')}"
        rows: list[tuple] = []

        def blocks() -> Iterator[bytes]:
            yield own
            at = len(own)
            docs: list[int | None] = []
            parts: list[np.ndarray] = []
            held = 0

            def close() -> bytes:
                nonlocal at
                ids = np.concatenate(parts)
                raw = block_bytes(docs, np.array([len(p) for p in parts]), ids, codes, lengths)
                rows.append((TaskContext.get().partitionId(), len(rows), path, at, len(raw), len(docs), len(ids)))
                at += len(raw)
                return raw

            for batch in batches:
                for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                    docs.append(doc)
                    parts.append(unsqueeze(packed.as_py()))
                    held += len(parts[-1])
                    if held >= BLOCK_IDS:
                        yield close()
                        docs, parts, held = [], [], 0
            if docs:
                yield close()

        write_shared(path, blocks())
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["file_no", "block_no", "path", "at", "size", "n_docs", "n_ids"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    ordered = tokens.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = ordered.select("doc_id", "ids").mapInArrow(
        tidy(write), "file_no long, block_no long, path string, at long, size long, n_docs long, n_ids long")
    return materialize(manifest, "id_manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids in all blocks before.  One row per file meets in one task, never the blocks."""
    files = manifest.groupBy("file_no").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(files, "file_no").select(
        "path", "at", "size", (F.col("file_start") + F.col("inside")).alias("start"))


def read_ids(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) from the files, ids as little-endian unsigned 32-bit bytes.

    With ``digest`` the ids are replaced by their CRC-32, ``ids_crc32``.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, tuple] = {}
        for batch in batches:
            for path, at, size, start in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if path not in opened:
                    opened.clear()
                    store, plain = open_store(path)
                    stream = store.open_input_file(plain)
                    opened[path] = (stream, decode_table(read_header(stream)))
                stream, table = opened[path]
                docs, counts, ids = read_block(stream.read_at(size, at), table)
                ends = np.cumsum(counts)
                parts = [ids[e - c:e].astype("<u4").tobytes() for e, c in zip(ends, counts)]
                last = pa.array([zlib.crc32(p) for p in parts], pa.int64()) if digest else pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), last],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    blocks = with_starts(manifest)
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, manifest.select("file_no").distinct().count())
    last = "ids_crc32 long" if digest else "ids binary"
    return blocks.repartition(tasks, "path", "at").mapInArrow(tidy(read), f"doc_id long, start long, n_tokens long, {last}")


def coded_ids(docs: DataFrame, path: str, cut: str = "words", end_id: int | None = 1, doc_id: str = "doc_id",
              text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenize, write the files to the shared folder, and give the manifest.

    An empty table gives an empty manifest; a null text only the end id.
    """
    tokens = materialize(tokenize(docs, path, cut, end_id, doc_id, text), "id_tokens")
    return write_ids(tokens, shared_folder(docs, "ids"), file_ids)
