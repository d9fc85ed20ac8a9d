import hashlib
import io
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest

from siftrank.llm import queries, sharding, warc_zip
from siftrank.llm.common import open_store, shared_folder


def check_shards(found, docs, n):
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    by = {}
    for r in found:
        assert r.law == "bytes" and 0 <= r.shard < n and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in by.get(s, [])) for s in range(n)]


def test_shards_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = sharding.assign_shards(docs).collect()
    sizes = check_shards(found, docs.collect(), 8)
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in found)
    again = sharding.assign_shards(docs).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)


def test_shards_of_odd_rows(spark, rows):
    check_shards(sharding.assign_shards(rows).collect(), rows.collect(), 8)
    assert sharding.assign_shards(rows.limit(0)).collect() == []
    same = spark.range(3000).selectExpr("7L as doc_id", "'same text' as text")
    sizes = check_shards(sharding.assign_shards(same).collect(), same.collect(), 8)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes)


def test_heavy_records_do_not_stall_the_rounds(spark, monkeypatch):
    rows = spark.range(3012).selectExpr("id as doc_id", "case when id < 12 then repeat('x', 300000 + cast(id as int)) else cast(id as string) end as text")
    drawn, counted = [], []
    draw, in_ranges = sharding.draw, sharding.in_ranges
    monkeypatch.setattr(sharding, "draw", lambda *a: drawn.append(1) or draw(*a))
    monkeypatch.setattr(sharding, "in_ranges", lambda r, s: counted.append(len(s)) or in_ranges(r, s))
    found = sharding.assign_shards(rows).collect()
    assert len(drawn) <= 3 and len(counted) <= 4
    sizes = check_shards(found, rows.collect(), 8)
    assert max(sizes) - min(sizes) <= 310_000


def test_next_key():
    keys = np.array([b"\0" * 24, b"a" * 23 + b"\xff", b"\xff" * 24], dtype="S24").view("V24")
    assert [bytes(k) for k in sharding.after(keys)][:2] == [b"\0" * 23 + b"\1", b"a" * 22 + b"b\0"]
    assert len(sharding.after(keys[:0])) == 0


def test_place_counts_splitters():
    chance = np.random.default_rng(0)
    keys = sharding.keys_of(*(chance.integers(-3, 3, 200) for _ in range(3)))
    ordered = sorted(k.tobytes() for k in keys)
    splitters = np.unique(keys[:40].view("S24")).view("V24")
    want = [sum(s.tobytes() <= k.tobytes() for s in splitters) for k in keys]
    assert sharding.place(splitters, keys).tolist() == want and ordered[0] <= ordered[-1]


def test_packages_are_zip_files(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = warc_zip.with_revisits(pages, "page_id", "url", "html", 1000)
    manifest = warc_zip.write_packages(rows, shared_folder(pages, "warc"), package_bytes=50_000).collect()
    assert sum(r.records for r in manifest) == pages.count() and len(manifest) > 1
    for r in manifest:
        with zipfile.ZipFile(open_store(r.path)[1]) as package:  # the standard library reads them
            assert package.testzip() is None and package.namelist() == [warc_zip.DATA, warc_zip.INDEX]
    payloads = {r.page_id: r.html for r in pages.collect()}
    frame = spark.createDataFrame([(r.path, r.size) for r in manifest], "path string, size long")
    for r in warc_zip.read_records(warc_zip.record_ranges(frame, 7)).collect():
        assert bytes(r.payload).decode() == payloads[r.page_id]


@pytest.mark.parametrize("far", [False, True])
def test_directory_with_and_without_zip64(far):
    body = b"hello" * 10
    head = warc_zip.local_header("a/b", zlib.crc32(body), len(body))
    raw = head + body + warc_zip.directory([("a/b", zlib.crc32(body), len(body), 0)], len(head) + len(body), force64=far)
    read_at = lambda n, at: raw[at:at + n]
    members = warc_zip.members_of(read_at, len(raw))
    at, size = warc_zip.stored_member(read_at, members, "a/b")
    assert raw[at:at + size] == body
    assert zipfile.ZipFile(io.BytesIO(raw)).read("a/b") == body
    commented = io.BytesIO()
    with zipfile.ZipFile(commented, "w") as package:
        package.writestr("x", "y" * 100)
        package.comment = b"PK\5\6 in a comment"
    data = commented.getvalue()
    found = warc_zip.members_of(lambda n, at: data[at:at + n], len(data))
    assert list(found) == ["x"]
    with pytest.raises(ValueError):
        warc_zip.members_of(lambda n, at: b"no package"[at:at + n], 10)


def test_odd_pages(spark):
    long = "z" * 1000
    data = [(1, "u", None), (2, None, ""), (3, "a\r\nb: c", long), (5, "u", long), (5, "u", long), (None, "u", long),
            (6, "u", "z" * 999), (7, "u", "z" * 999), (8, "u", "é\r\n\r\n" * 400)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as size")
    found = warc_zip.warc_round_trip(pages).collect()
    payload = {p: (h or "").encode() for p, _, h in data}
    assert len(found) == len(data)
    for r in found:
        assert r.payload_bytes == len(payload[r.page_id])
        assert r.payload_digest == hashlib.sha1(payload[r.page_id]).hexdigest()
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in found)
    assert kinds[5, "response", None] == 1 and kinds[5, "revisit", 5] == 1 and kinds[3, "revisit", 5] == 1
    assert kinds[None, "revisit", 5] == 1 and kinds[6, "response", None] == kinds[7, "response", None] == 1
    assert warc_zip.warc_round_trip(pages.limit(0)).count() == 0


def test_sql(spark, sf):
    from tools.check_oracle import connect, rows_of
    frame = queries.QUERIES["op10_warc"](spark, sf)
    result = connect(sf).execute(queries.SQL["op10_warc"])
    names = [d[0] for d in result.description]
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, result.fetchall())
