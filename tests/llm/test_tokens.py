"""Packing, piece encoding and coded ids beside the libraries and by round trips."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siftrank.llm import huffman_ids, packing, sentencepiece_bpe, token_ids

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("path, cut", [(BYTES, "bytes"), (WORDS, "words")])
def test_cut_texts_have_the_same_ids(spark, sf, rows, path, cut):
    texts = [r.text or "" for r in [*rows.collect(), *documents(spark, sf).collect()]]
    texts += ["a. \n b", "a.. b", "(a). b", "x . y", "it's we're.", " lead", "trail ", "n.\nM", "a\x1fb. c"]
    library = Tokenizer.from_file(path)
    for text, found in zip(texts, token_ids.encode_texts(path, cut, texts)):
        assert np.frombuffer(found, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check_packing(found, texts, capacity):
    library = Tokenizer.from_file(BYTES)
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts}
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        times = Counter((r.start, r.length) for r in own)
        if max(times.values()) > 1:
            continue  # repeated rows are checked by their number below
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc])
            at += r.length
            assert zlib.crc32(np.array(ids[doc][r.start:at], "<u4").tobytes()) == r.ids_crc32
        assert at == len(ids[doc])
    assert sum(r.length for r in found) == sum(len(ids[d]) for d, _ in texts)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding


def test_packing(spark, sf):
    docs = documents(spark, sf)
    found = packing.pack(docs, BYTES).collect()
    assert check_packing(found, [(r.doc_id, r.text) for r in docs.collect()], 2048) == 0


def test_packing_odd_rows(rows):
    distinct = rows.filter("doc_id < 18 or doc_id is null")
    found = packing.pack(distinct, BYTES, capacity=64).collect()
    assert check_packing(found, [(r.doc_id, r.text) for r in distinct.collect()], 64) == 0
    assert packing.pack(rows, BYTES).groupBy("doc_id").count().filter("doc_id = 18").first()["count"] >= 2
    assert packing.pack(rows.limit(0), BYTES).count() == 0


def test_best_fill_is_the_best_subset():
    chance = random.Random(5)
    for _ in range(40):
        counts = Counter(chance.randint(1, 30) for _ in range(8))
        use = packing.best_fill(dict(counts), 40)
        longest = max(counts)
        assert all(counts[k] >= n for k, n in use.items()) and use[longest] >= 1
        items = list((counts - Counter([longest])).elements())
        sums = {longest}
        for item in items:
            sums |= {s + item for s in sums if s + item <= 40}
        assert sum(k * n for k, n in use.items()) == max(sums)


@pytest.mark.parametrize("histogram", [
    {1500: 1000}, {1500: 1, 2047: 2, 700: 3000}, {2048: 5, 1500: 3000, **{k: k % 5 + 1 for k in range(1, 2048, 9)}},
    {k: k % 7 + 1 for k in range(1100, 2001, 5)}, {5: 3}, {}])
def test_plans_grow_with_the_lengths_only(histogram):
    sizes = []
    for scale in (1, 100):
        counted = {k: n * scale for k, n in histogram.items()}
        plan = packing.plan_packing(counted)
        sizes.append(len(plan.runs))
        if scale > 1:
            continue
        pieces, windows = {}, {}
        for of, first, last, start, size, per, phase, sequence, offset in plan.runs:
            for i, k in enumerate(range(first, last), phase):
                pieces.setdefault((of, k), []).append((start, size))
                windows.setdefault(sequence + i // per, []).append((offset + i % per * size, size))
        assert sorted(pieces) == [(of, k) for of in sorted(counted) for k in range(counted[of])]
        for spans, ends in [(v, {of}) for (of, _), v in pieces.items()] + [
                (v, {2048, *(1 << i for i in range(11))}) for v in windows.values()]:
            spans = sorted(spans)
            assert [a + n for a, n in spans[:-1]] == [a for a, _ in spans[1:]] and spans[0][0] == 0
            assert sum(n for _, n in spans) in ends
        assert sorted(windows) == list(range(plan.sequences))
    assert sizes[1] <= 3 * sizes[0] + 2048  # the last window's pieces are placed one by one


@pytest.mark.parametrize("few", [0, 100_000])
def test_packing_many_equal_lengths(spark, monkeypatch, few):
    monkeypatch.setattr(packing, "FEW_PARTS", few)
    texts = [(i, "the cat " * (22 if i % 3 else 21 + i % 2)) for i in range(600)] + [(600, "one " * 200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert check_packing(packing.pack(docs, BYTES, capacity=64).collect(), texts, 64) == 0


def test_pieces(spark, sf, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (documents(spark, sf), rows):
        found = sentencepiece_bpe.encode_pieces(docs, PIECES)
        assert found.columns == [*docs.columns, "piece_ids", "decoded"]
        for r in found.collect():
            ids = library.encode(r.text or "")
            assert r.piece_ids == ids and r.decoded == library.decode(ids)
        short = sentencepiece_bpe.piece_digests(docs, PIECES).collect()
        want = Counter()
        for r in docs.collect():
            ids = library.encode(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                 hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in short) == want
    assert sentencepiece_bpe.encode_pieces(rows.limit(0), PIECES).count() == 0


def test_both_agendas_agree():
    own = sentencepiece_bpe.pieces(PIECES)
    chunks = ["▁" + w for w in "aaaaaaaaaaaa international zzzz the ção 🙂🙂 日本".split()] + ["▁▁▁▁", "▁"]
    assert own.side_by_side(chunks) == [own.heap(c) for c in chunks]


def test_any_ids_decode_as_the_library_does():
    own = sentencepiece_bpe.pieces(PIECES)
    chance = random.Random(1)
    for n in range(60):
        ids = [chance.choice([chance.randrange(32000), 3 + chance.randrange(256)]) for _ in range(n)]
        assert own.decode(ids) == own.library.decode(ids)


def test_code_lengths():
    assert huffman_ids.code_lengths(np.zeros(0, int)).tolist() == []
    assert huffman_ids.code_lengths(np.array([0, 7])).tolist() == [0, 1]
    assert huffman_ids.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32]), 16).tolist() == [6, 6, 5, 4, 3, 2, 1]
    tight = huffman_ids.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32, 64, 128]), 4)
    assert tight.max() == 4 and (2.0 ** -tight.astype(float)).sum() <= 1
    assert huffman_ids.code_lengths(np.ones(100, int), 4).max() == 7  # the least limit for a hundred ids


def test_bits_round_trip():
    chance = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = (chance.zipf(1.3, n) % 3000).astype(np.int64)
        lengths = huffman_ids.code_lengths(np.bincount(ids, minlength=3000))
        bits, lanes = huffman_ids.pack_bits(ids, huffman_ids.canonical_codes(lengths), lengths)
        back = huffman_ids.unpack_bits(np.frombuffer(bits, np.uint8), lanes, n, huffman_ids.decode_table(lengths))
        assert back.tolist() == ids.tolist()


def test_id_files(spark, sf, rows):
    library = Tokenizer.from_file(WORDS)
    for docs, file_ids in ((documents(spark, sf), 20_000), (rows, 50), (rows.limit(0), 50)):
        found = huffman_ids.read_ids(huffman_ids.coded_ids(docs, WORDS, file_ids=file_ids)).collect()
        want = Counter((r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
        assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found) == want
        at, before = 0, -1
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.n_tokens == len(r.ids) // 4 and (r.doc_id if r.doc_id is not None else -1) >= before
            at, before = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
