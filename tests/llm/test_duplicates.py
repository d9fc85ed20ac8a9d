"""Near duplicates, repeats and neighbours beside brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrank.llm import hamming_search, jaccard_join, shingles, suffix_arrays, suffix_dedup
from siftrank.llm.components import components

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def plain_components(texts):
    """Component of each row: the smallest id reachable, by comparing all that share a shingle."""
    sets = [(d, shingle_set(t)) for d, t in texts]
    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, s) in enumerate(sets):
        both = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min([x for x in (least.get(top(i)), d) if x is not None], default=None)
    return Counter((d, len(s), least[top(i)] if s else d) for i, (d, s) in enumerate(sets))


def check_join(docs):
    found = Counter(tuple(r) for r in jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert found == plain_components([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates(spark, sf, rows):
    check_join(spark.read.parquet(f"{sf}/documents.parquet"))
    check_join(rows)
    assert jaccard_join.near_duplicates(rows.limit(0)).count() == 0


def family(chance, words, size, edits):
    base = [f"w{chance.randrange(words)}" for _ in range(size)]
    out = []
    for _ in range(12):
        own = list(base)
        for _ in range(chance.randrange(edits + 1)):
            own[chance.randrange(len(own))] = f"w{chance.randrange(words)}"
        out.append(" ".join(own[chance.randrange(3):]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_links_around_the_threshold(spark, seed):
    """Families of texts that share much with each other, chains of links, and a passage in all of them."""
    chance = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [t for size in (8, 20, 60, 120) for _ in range(4) for t in family(chance, 5000, size, size // 10 + 1)]
    texts += [f"{passage} {' '.join(f'u{i}x{j}' for j in range(chance.randrange(5, 20)))}" for i in range(40)]
    chain = [f"c{i}" for i in range(100)]
    texts += [" ".join(chain[i:i + 60]) for i in range(0, 40, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    check_join(docs)


def test_one_of_each(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, c in want.elements() if n == 0 or d == c)
    odd = jaccard_join.one_of_each(rows)
    assert odd.columns == rows.columns and odd.filter("text = 'same text here now ok yes'").count() == 1
    assert jaccard_join.one_of_each(rows.limit(0)).count() == 0


def test_components(spark):
    chance = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    edges += [(chance.randrange(2000, 2400), chance.randrange(2000, 2400)) for _ in range(150)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert found == {x: top(x) for x in parent if x != 5000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingles_of_words():
    texts = ["A b C d E f", "a b c d e f", "a b", "", "\x0b a\x1fb \xa0 c", "éa b c d e é"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found = shingles.Shingler().sets(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert [len(f) for f in found] == [len(shingle_set(t)) for t in texts]
    assert found[0].tolist() == found[1].tolist()


@pytest.mark.parametrize("letters", [1, 2, 4, 250])
def test_suffix_arrays(letters):
    for n in (0, 1, 2, 7, 60, 500):
        data = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
        raw = data.tobytes()
        order = suffix_arrays.suffix_array(data)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        shared = suffix_arrays.common_prefixes(data, order)
        for i in range(1, n):
            a, b = raw[order[i - 1]:], raw[order[i]:]
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            assert shared[i] == k


def plain_repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    times = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if times[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()


def check_repeats(docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((d, *w) for (d, _), w in zip(texts, plain_repeats([t for _, t in texts])))
    assert Counter(tuple(r) for r in suffix_dedup.repeat_report(docs).collect()) == want


def test_repeats(spark, sf, rows):
    check_repeats(spark.read.parquet(f"{sf}/documents.parquet"))
    check_repeats(rows)
    assert suffix_dedup.repeat_report(rows.limit(0)).count() == 0


@pytest.mark.parametrize("part, group", [(512, 1 << 20), (4, 700)])
def test_repeats_at_every_offset(spark, monkeypatch, part, group):
    """Shared passages of all lengths around 200 bytes, runs of one letter, and split anchors and texts."""
    monkeypatch.setattr(suffix_dedup, "PART_SEGMENTS", part)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    chance = random.Random(part)
    word = lambda n: "".join(chance.choice("abcdefgh é") for _ in range(n))
    passage = word(400)
    texts = ["x" * 450, "ab" * 300, "", None, word(199), word(200)]
    for size in (150, 198, 199, 200, 201, 230, 300, 400):
        for _ in range(5):
            at = chance.randrange(0, 400 - size + 1)
            texts.append(word(chance.randrange(300)) + passage[at:at + size] + word(chance.randrange(300)))
    texts += [texts[-1], texts[-1]]
    check_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))


def test_cut_texts_are_whole_characters(spark, rows):
    passage = "é" * 150
    docs = spark.createDataFrame([(1, "a" + passage + "b", 7), (2, "cé" + passage + "d", 8), (3, None, 9), (4, "short", 1)],
                                 "doc_id long, text string, rest long")
    found = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert suffix_dedup.without_repeats(docs).columns == docs.columns
    assert found[1].text == "ab" and found[2].text == "cd" and found[3].text is None and found[4].text == "short"
    assert [found[i]["rest"] for i in (1, 2, 3, 4)] == [7, 8, 9, 1]
    assert suffix_dedup.without_repeats(rows).columns == rows.columns
    assert suffix_dedup.without_repeats(rows).count() == rows.count()


def vectors(spark, values):
    return spark.createDataFrame(values, "vec_id long, embedding array<float>, score string, rank int")


def test_nearest(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = hamming_search.nearest(table, F.col("id") % 20 == 0).collect()
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    ids, base = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    truth = dict(hamming_search.brute_force(ids, base, np.flatnonzero(ids % 20 == 0), 20))
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r)
        assert abs(r.score - base[ids == r.query_id][0] @ base[ids == r.vec_id][0]) < 1e-12
    assert set(by) == set(truth) and all([r.rank for r in own] == list(range(1, 21)) for own in by.values())
    assert all(own[i].score >= own[i + 1].score for own in by.values() for i in range(19))
    assert np.mean([len({r.vec_id for r in own} & set(truth[q])) / 20 for q, own in by.items()]) >= 0.9


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    values = [(0, [1.0, 0.0], "a", 1), (0, [1.0, 0.0], "a", 1), (1, [3.0, 0.0], "a", 1), (2, [0.5, 0.5], "a", 1),
              (3, [0.5, 0.5], "a", 1), (20, None, "a", 1), (40, [0.0, 0.0], "a", 1), (60, [nan, 1.0], "a", 1),
              (80, [inf, 1.0], "a", 1), (100, [None, 1.0], "a", 1), (5, [1.0], "a", 1), (None, [9.0, 9.0], "a", 1), (7, [-1.0, 0.0], "a", 1)]
    found = hamming_search.nearest(vectors(spark, values), F.col("id") % 20 == 0, k=20)
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in found.orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 2, 0.5), (0, 3, 3, 0.5), (0, 4, 7, -1.0)]
    assert hamming_search.nearest(vectors(spark, []), F.col("id") % 20 == 0).count() == 0


def test_probing_finds_every_code_in_reach():
    chance = np.random.default_rng(4)
    codes = chance.integers(0, 1 << 16, (300, 4)).astype(np.uint16)
    near = codes[0] ^ (1 << chance.integers(0, 16, (50, 4))).astype(np.uint16)
    codes = np.concatenate([codes, near])
    shard = hamming_search.Shard(codes)
    far = hamming_search.distances(codes[:5], codes)
    for radius in range(0, 12):
        for q in range(5):
            assert shard.within(codes[q], radius).tolist() == np.flatnonzero(far[q] <= radius).tolist()
