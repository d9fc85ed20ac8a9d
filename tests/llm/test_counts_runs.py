"""Token counts beside the library, and runs of words beside brute force."""

import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftrank.llm import periodic_runs, token_counts
from siftrank.llm.queries import QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library_counts(texts):
    library = Tokenizer.from_file(BYTES)
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_cuts_are_those_of_the_library():
    own = random.Random(5)
    parts = ["a", "b", "S", "s", "t", "re", "ve", "ll", "m", "d", "'", " ", "  ", "\n", "\t", "1", "²", "é", "日", "🙂", "\xa0", "　",
             "́", "!", "<|endoftext|>", "<|", "\0", "'s", "​", "\x1c", "\x85"]
    texts = ["".join(own.choice(parts) for _ in range(own.randrange(25))) for _ in range(4000)]
    texts += ["x" * 5000, " " * 3000, "", "a" * 16 + " " + "b" * 15, "<|endoftext|>" * 3]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    misses = token_counts.MissCounter(BYTES)
    table = token_counts.LengthTable([b" a", b"'s", b"b" * 15], [1, 1, misses[b"b" * 15]])
    found = token_counts.count_batch(data, offsets, token_counts.character_classes(BYTES), table, misses, ["<|endoftext|>"])
    assert found.tolist() == library_counts(texts)


def test_all_documents_have_the_counts_of_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in QUERIES["op11_token_counts"](spark, sf).collect()}
    assert len(found) == len(docs)
    for doc, n in zip(docs, library_counts([d.text for d in docs])):
        r = found[doc.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((doc.text or "").encode()), n, n > 512)


def test_counts_of_odd_rows(spark, rows):
    texts = rows.select("doc_id", "text").collect()
    found = token_counts.token_counts(rows.repartition(3), BYTES, limit=3, frequent=2).collect()
    want = sorted((str(d.doc_id), n, n > 3) for d, n in zip(texts, library_counts([d.text for d in texts])))
    assert sorted((str(r.doc_id), r.n_tokens, r.over_limit) for r in found) == want
    assert token_counts.token_counts(rows.limit(0), BYTES).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.token_counts(rows.limit(0), BYTES).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(rows, public_tokenizers.path("word_bpe_49k.json"))


def test_a_sketch_keeps_what_is_frequent():
    own = random.Random(1)
    pieces = [b"often"] * 400 + [b"also"] * 300 + [b"rare%d" % i for i in range(1500)]
    own.shuffle(pieces)
    sketches = []
    for part in range(5):
        sketch = token_counts.Sketch(limit=8)
        for piece in pieces[part::5]:
            lo, hi, _ = token_counts.piece_keys(np.frombuffer(piece, np.uint8), np.array([0]))
            sketch.add(lo, hi, np.array([1]))
        sketches.append(sketch.dump())
    whole = token_counts.Sketch(limit=8)
    for state in sketches:
        whole.merge(state)
    found = np.frombuffer(whole.dump(), token_counts.SKETCH)
    assert len(found) <= 8
    lo = [token_counts.piece_keys(np.frombuffer(p, np.uint8), np.array([0]))[0][0] for p in (b"often", b"also")]
    assert set(lo) <= set(found["lo"])


def test_frequent_pieces_come_from_all_partitions(spark):
    texts = spark.range(300).select(F.concat(F.lit("the cat "), F.col("id").cast("string"))).repartition(150)
    assert {b"the", b" cat"} <= set(token_counts.frequent_pieces(texts, BYTES, limit=16))


def brute_runs(words):
    spans = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                spans.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in spans.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words):
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return len(runs), *best, runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(own):
    kinds, n = own.choice([1, 2, 3, 5, 50]), own.randrange(300)
    words = [f"w{own.randrange(kinds)}" for _ in range(n)]
    for _ in range(own.randrange(4)):
        if n:
            a, p, m = own.randrange(n), own.randrange(1, 40), own.randrange(1, 200)
            for j in range(a + p, min(n, a + m)):
                words[j] = words[j - p]
    return words


@pytest.mark.parametrize("tile", [8, 64, 1 << 14])
def test_runs_are_those_of_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(periodic_runs, "TILE_WORDS", tile)
    own = random.Random(tile)
    docs = [(i, repetitive(own)) for i in range(250)]
    docs += [(1000, ["a", "b"] * 700), (1001, ["x"] * 1500), (1002, [f"p{i % 97}" for i in range(2000)])]
    table = spark.createDataFrame([(i, "\n ".join(w)) for i, w in docs], "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in periodic_runs.collapse_runs(table).collect()}
    for i, words in docs:
        r = found[i]
        runs = [(x.start, x.length, x.period) for x in r.runs]
        assert (r.n_runs, r.start, r.length, r.period, runs, r.collapsed) == brute_collapse(words), i
        assert r.exponent_milli == (None if not runs else 1000 * r.length // r.period)


def test_registered_runs_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(found) == len(docs)
    for doc in docs:
        words = periodic_runs.planted((doc.text or "").encode().split(), doc.doc_id)
        r = found[doc.doc_id]
        if len(words) < 2500:
            want = periodic_runs.finish(words, brute_runs(words), True)
            assert tuple(r)[1:] == want, doc.doc_id
    assert sum(r.n_runs > 0 for r in found.values()) >= len(docs) // 20


def test_runs_of_odd_rows(spark, rows):
    found = periodic_runs.collapse_runs(rows).collect()
    assert len(found) == rows.count()
    texts = rows.select("doc_id", "text").collect()
    want = sorted((str(d.doc_id), len(brute_runs((d.text or "").encode().split()))) for d in texts if d.text != "ab " * 3000)
    got = sorted((str(r.doc_id), r.n_runs) for r in found if r.collapsed != "ab")
    assert got == want
    assert sum(r.collapsed == "ab" and r.length == 3000 for r in found) == sum(d.text == "ab " * 3000 for d in texts)
    assert periodic_runs.collapse_runs(rows.limit(0)).count() == 0
    assert periodic_runs.collapse_runs(periodic_runs.plant_repeats(rows), digest=True).count() == rows.count()


def test_planted_words_repeat():
    words = [b"%d" % i for i in range(100)]
    marked = [i for i in range(200) if periodic_runs.planted(words, i) != words]
    assert 5 < len(marked) < 40
    assert periodic_runs.planted(words, None) == words and periodic_runs.planted([], marked[0]) == []
