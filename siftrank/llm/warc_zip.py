"""WARC records in ZIP packages, written and read back by byte ranges.

A package holds two stored (not compressed) members: ``archive/data.warc.gz``,
one gzip member per record, and ``indexes/index.cdx.gz``, one line per record
with its place in the first member.  The reader takes the end records (ZIP64
ones where there are any), the central directory and the local headers to find
where a member's bytes begin, reads the index, and then fetches single records
with range reads.  Nothing is unpacked to disk.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.llm.common import bound_batches, named, open_store, shared_folder, task_name, tidy, whole_text, write_shared
from siftrank.scratch import materialize

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx.gz"
REVISIT_BYTES = 1000    # shorter payloads are stored again
PACKAGE_BYTES = 256 << 20  # a package is closed beyond this size
LARGE = 0xFFFFFFFF
READ_RECORDS = 512      # records of one range-read task row
DATE = "2000-01-01T00:00:00Z"  # records made from a table have no fetch time


# --- ZIP packages ---------------------------------------------------------

def local_header(name: str, crc: int, size: int) -> bytes:
    """Local file header of a stored member; sizes go to the ZIP64 field when they need it."""
    raw = name.encode()
    extra = struct.pack("<HHQQ", 1, 16, size, size) if size >= LARGE else b""
    short = LARGE if size >= LARGE else size
    return struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if extra else 20, 0x800, 0, 0, 0x21, crc, short, short,
                       len(raw), len(extra)) + raw + extra


def streamed_header(name: str) -> bytes:
    """Local file header of a stored member whose checksum and ZIP64 sizes follow its bytes."""
    raw = name.encode()
    extra = struct.pack("<HHQQ", 1, 16, 0, 0)
    return struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x808, 0, 0, 0x21, 0, LARGE, LARGE, len(raw), len(extra)) + raw + extra


def descriptor(crc: int, size: int) -> bytes:
    """What follows a member with a streamed header."""
    return struct.pack("<4sIQQ", b"PK\7\10", crc, size, size)


def directory(members: list[tuple[str, int, int, int]], at: int, force64: bool = False, streamed: frozenset | set = frozenset()) -> bytes:
    """Central directory and end records of members (name, crc, size, offset)."""
    out = []
    for name, crc, size, offset in members:
        raw = name.encode()
        fields = []
        if size >= LARGE or force64:
            fields += [size, size]
        if offset >= LARGE or force64:
            fields += [offset]
        extra = struct.pack(f"<HH{len(fields)}Q", 1, 8 * len(fields), *fields) if fields else b""
        short = LARGE if size >= LARGE or force64 else size
        out.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if extra or name in streamed else 20,
                               0x808 if name in streamed else 0x800, 0, 0, 0x21, crc, short,
                               short, len(raw), len(extra), 0, 0, 0, 0,
                               LARGE if offset >= LARGE or force64 else offset) + raw + extra)
    body = b"".join(out)
    many = len(members) >= 0xFFFF or at >= LARGE or len(body) >= LARGE or force64
    end = b""
    if many:
        end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(body), at)
        end += struct.pack("<4sIQI", b"PK\6\7", 0, at + len(body), 1)
    short_n = 0xFFFF if many else len(members)
    return body + end + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, short_n, short_n, LARGE if many else len(body),
                                    LARGE if many else at, 0)


def members_of(read_at, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a package: name to (method, size, offset of the local header).  ``read_at(n, at)`` reads a range."""
    tail_at = max(0, size - 65557)
    tail = read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\5\6", 0, max(0, len(tail) - 18))
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\5\6", 0, end + 3)  # a comment may hold the same letters
    if end < 0:
        raise ValueError("no end record: not a ZIP package")
    n, _, length, at = struct.unpack_from("<HHII", tail, end + 8)
    n = struct.unpack_from("<H", tail, end + 10)[0]
    if n == 0xFFFF or length == LARGE or at == LARGE:
        locator = read_at(20, tail_at + end - 20)
        if locator[:4] == b"PK\6\7":
            far = read_at(56, struct.unpack_from("<Q", locator, 8)[0])
            if far[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record where the locator points")
            n, length, at = struct.unpack_from("<QQQ", far, 32)
    raw, place, found = read_at(length, at), 0, {}
    for _ in range(n):
        if raw[place:place + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", raw, place + 10)[0]
        packed, whole = struct.unpack_from("<II", raw, place + 20)
        name_size, extra_size, note_size = struct.unpack_from("<HHH", raw, place + 28)
        offset = struct.unpack_from("<I", raw, place + 42)[0]
        name = raw[place + 46:place + 46 + name_size].decode()
        extra = raw[place + 46 + name_size:place + 46 + name_size + extra_size]
        step = 0
        while step + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, step)
            if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                values = list(struct.unpack_from(f"<{width // 8}Q", extra, step + 4))
                if whole == LARGE:
                    whole = values.pop(0)
                if packed == LARGE:
                    packed = values.pop(0)
                if offset == LARGE:
                    offset = values.pop(0)
            step += 4 + width
        found[name] = (method, packed, offset)
        place += 46 + name_size + extra_size + note_size
    return found


def stored_member(read_at, members: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    """Where the bytes of a stored member begin, and how many they are."""
    method, size, offset = members[name]
    if method != 0:
        raise ValueError(f"{name} is compressed; only stored members can be read by range")
    head = read_at(30, offset)
    if head[:4] != b"PK\3\4":
        raise ValueError("no local header where the directory points")
    name_size, extra_size = struct.unpack_from("<HH", head, 26)
    return offset + 30 + name_size + extra_size, size


# --- WARC records ---------------------------------------------------------

def record_id(page: object) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def warc_record(kind: str, page: object, url: str, digest: str, size: int, payload: bytes, refers_to: object) -> bytes:
    """One record as a gzip member.  The block of a response is a bare HTTP response; a revisit has its head only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if kind == "response":
        block += payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, the payload as far as it is stored, and the length that the HTTP head states."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return headers, payload, stated


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, revisit_bytes: int) -> DataFrame:
    """Rows to write: page_id, url, payload, size, digest, kind, refers_to.

    Of equal payloads of at least ``revisit_bytes`` the row with the largest
    page id is the response (of rows that are equal in that too, the first in
    the input); a null page id is the smallest.
    """
    bound_batches(pages)
    body = whole_text(named(pages, html))
    address = named(pages, url) if url in pages.columns else F.lit("")
    rows = pages.select(
        named(pages, page_id).cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"),
        F.regexp_replace(whole_text(address), r"[\r\n]", " ").alias("url"), body.alias("payload"),
        F.octet_length(body).cast("long").alias("size"), F.sha1(body.cast("binary")).alias("digest"))
    best = rows.filter(F.col("size") >= revisit_bytes).groupBy("digest").agg(
        F.max(F.struct("page_id", (-F.col("row")).alias("turn"))).alias("best"), F.count(F.lit(1)).alias("copies"))
    best = best.filter("copies > 1").select(
        "digest", F.col("best.page_id").alias("first"), (-F.col("best.turn")).alias("first_row"))
    revisit = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    return rows.join(best, "digest", "left").select(
        "page_id", "url", "payload", "size", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def write_packages(rows: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the records and give the manifest: path, size and records of every package.

    A task that is run again writes packages of another name; the manifest
    names those that count.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[str, int, int]] = []

        def records() -> Iterator[tuple[object, str, str, bytes]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    page, url, payload, size, digest, kind, refers = (c[i].as_py() for c in batch.columns)
                    yield page, kind, digest, warc_record(kind, page, url, digest, size, payload.encode(), refers)

        def package(first: tuple, others: Iterator[tuple], counted: list[int]) -> Iterator[bytes]:
            """The bytes of a package, a record at a time; only the packed index is held."""
            index, held, at, crc = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0, 0
            start = streamed_header(DATA)
            yield start
            for page, kind, digest, raw in chain([first], others):
                line = json.dumps({"page": page, "type": kind, "digest": digest, "offset": at, "length": len(raw)})
                held.append(index.compress((line + "\n").encode()))
                counted.append(1)
                yield raw
                at += len(raw)
                crc = zlib.crc32(raw, crc)
                if at >= package_bytes:
                    break
            listed = b"".join(held) + index.flush()
            end = descriptor(crc, at)
            second = local_header(INDEX, zlib.crc32(listed), len(listed))
            middle = len(start) + at + len(end)
            yield from (end, second, listed)
            yield directory([(DATA, crc, at, 0), (INDEX, zlib.crc32(listed), len(listed), middle)],
                            middle + len(second) + len(listed), streamed={DATA})

        waiting = records()
        for first in waiting:
            counted: list[int] = []
            path = f"{folder}/{task_name(f'pages-{len(made)}', '.zip')}"
            size = write_shared(path, package(first, waiting, counted))
            made.append((path, size, len(counted)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()),
             pa.array([m[2] for m in made], pa.int64())], names=["path", "size", "records"])

    return materialize(rows.mapInArrow(tidy(write), "path string, size long, records long"), "warc_manifest")


def record_ranges(packages: DataFrame, records: int = READ_RECORDS) -> DataFrame:
    """From (path, size): the places of all records, in rows of up to ``records`` neighbours."""
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, plain = open_store(path)
                with store.open_input_file(plain) as stream:
                    members = members_of(stream.read_at, size)
                    start, _ = stored_member(stream.read_at, members, DATA)
                    at, length = stored_member(stream.read_at, members, INDEX)
                    lines = zlib.decompress(stream.read_at(length, at), 31).decode().split("\n")
                entries = [json.loads(line) for line in lines if line]
                paths, offsets, lengths = [], [], []
                for i in range(0, len(entries), records):
                    some = entries[i:i + records]
                    paths.append(path)
                    offsets.append([start + e["offset"] for e in some])
                    lengths.append([e["length"] for e in some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(paths, pa.string()), pa.array(offsets, pa.list_(pa.int64())),
                     pa.array(lengths, pa.list_(pa.int64()))], names=["path", "offsets", "lengths"])

    tasks = packages.sparkSession.sparkContext.defaultParallelism
    spread = packages.select("path", "size").repartition(max(tasks, packages.count()), "path")
    return spread.mapInArrow(locate, "path string, offsets array<bigint>, lengths array<bigint>")


def read_records(ranges: DataFrame, payload: bool = True) -> DataFrame:
    """Fetch the records by range: page_id, url, record_type, refers_to, stated_bytes, digest (hex of the header),
    payload_bytes and payload_digest of what is stored, and the payload itself unless ``payload`` is off."""
    def page_of(value: str | None) -> int | None:
        text = (value or "")[len("<urn:page:"):-1]
        return int(text) if text else None

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offsets, lengths in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = []
                store, plain = open_store(path)
                with store.open_input_file(plain) as stream:
                    for at, length in zip(offsets, lengths):
                        headers, body, stated = parse_record(stream.read_at(length, at))
                        rows.append((
                            page_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], headers["WARC-Type"],
                            page_of(headers.get("WARC-Refers-To")), stated,
                            base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex(), len(body),
                            hashlib.sha1(body).hexdigest(), body if payload else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(),
                         pa.string(), pa.binary()]
                names = ["page_id", "url", "record_type", "refers_to", "stated_bytes", "digest", "payload_bytes",
                         "payload_digest", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    tasks = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(tasks * 4).mapInArrow(
        tidy(fetch), "page_id long, url string, record_type string, refers_to long, stated_bytes long, digest string, "
               "payload_bytes long, payload_digest string, payload binary")


def warc_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                    revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write the pages as packages, read them back, and give one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to.  A response
    is measured on its stored payload; a revisit takes both figures from the
    response it refers to, which must have the digest of its own header.  A null
    html is an empty payload; an empty table gives no rows.
    """
    rows = with_revisits(pages, page_id, url, html, revisit_bytes)
    manifest = write_packages(rows, shared_folder(pages, "warc"))
    read = materialize(read_records(record_ranges(manifest), payload=False).drop("payload", "url"), "warc_read")
    stored = read.filter("record_type = 'response'")
    # One response per digest is referred to, so this table has a row for each group of copies only.
    targets = stored.select("page_id", "payload_bytes", "payload_digest").filter(
        F.col("payload_bytes") >= revisit_bytes).dropDuplicates(["page_id", "payload_digest"]).select(
        F.col("page_id").alias("to"), F.col("payload_digest").alias("to_digest"), F.col("payload_bytes").alias("to_bytes"))
    revisits = read.filter("record_type = 'revisit'").join(
        targets, F.col("refers_to").eqNullSafe(F.col("to")) & (F.col("digest") == F.col("to_digest")), "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    lost = F.raise_error(F.concat(F.lit("no response for the payload "), F.col("digest")))
    return stored.select(*names).unionByName(revisits.select(
        "page_id", F.coalesce("to_bytes", lost.cast("long")).alias("payload_bytes"), F.col("to_digest").alias("payload_digest"),
        "record_type", "refers_to"))
