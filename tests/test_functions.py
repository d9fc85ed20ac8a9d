import threading
import time

import pytest
from pyspark.sql import functions as F

from siftrank.functions import attributes as attr
from siftrank.functions import models, prompts, text, vectors
from siftrank.functions.models import bag_of_words, word_overlap


def values(spark, expression, rows, schema="x string"):
    frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in frame.select(expression).collect()]


def test_brand(spark):
    rows = [" Nike\t", "nan", "", None, " Sony ", " NaN "]
    assert values(spark, attr.brand(F.col("x")), rows) == ["nike", None, None, None, "sony", None]


def test_colors(spark):
    rows = ["Red/Blue", "Space Gray", "Red, Navy, Gold", "red-RED", None, "nan", "Deep & Bright"]
    assert values(spark, attr.colors(F.col("x")), rows) == [
        ["red", "blue"], ["gray"], ["red", "navy", "gold"], ["red"], [], [], []]


def test_numbers(spark):
    assert values(spark, attr.rating(F.col("x")), ["4.5", "5.1", "-1", "NaN", "x", None, " 5 "]) == [
        4.5, None, None, None, None, None, 5.0]
    assert values(spark, attr.count(F.col("x")), ["3.9", "inf", "NaN", "x", "-2.9", None]) == [
        3, None, None, None, -2, None]


def test_features(spark):
    rows = ["Color:Gray | Material:Wood | Width:36 inches", "a:1|a:2", "a:b:c", "x", "", None, "a: |:b|c:d"]
    assert values(spark, attr.features(F.col("x")), rows) == [
        {"color": "Gray", "material": "Wood", "width": "36 inches"}, {"a": "2"}, {"a": "b:c"}, {}, {}, {}, {"c": "d"}]


def test_feature_order_is_that_of_the_first_key(spark):
    got = values(spark, F.array_join(F.map_values(attr.features(F.col("x"))), ","), ["b:1|a:2|b:3"])
    assert got == ["3,2"]


def test_full_text(spark):
    segments = [F.lit("A"), F.lit(" A"), F.lit(None), F.lit("nan"), F.lit("B")]
    assert values(spark, attr.text_of(*segments), [""]) == ["A B"]
    assert values(spark, attr.bullets(F.col("x")), ["a|b\n\nc "]) == ["a b c"]


def test_gain(spark):
    gains = {"EXACT": 3.0, "E": 3.0}
    assert values(spark, attr.gain(F.col("x"), gains), [" exact ", "e", "zzz", None]) == [3.0, 3.0, None, None]


@pytest.mark.parametrize("query, cleaned, legacy", [
    ("I'm looking for some great rugs", "rugs", "rugs"),
    ("cool", "cool", "cool"),
    ("looking for antique mirror", "antique mirror", "ntique mirror"),
    ("I want apples", "apples", "pples"),
    ("can you show me a nice lamp", "lamp", "lamp"),
    ("hello   sofa", "sofa", "sofa"),
    ("i'd love to check out armchairs", "armchairs", "armchairs"),
    ("sofa", "sofa", "sofa"),
    ("", "", ""),
])
def test_clean_query(spark, query, cleaned, legacy):
    assert values(spark, text.clean_query(F.col("x")), [query]) == [cleaned]
    assert values(spark, text.clean_query(F.col("x"), legacy=True), [query]) == [legacy]


def test_terms(spark):
    assert values(spark, text.tokens(F.col("x")), ["Éa-B2 b2", "", None]) == [["éa", "b2", "b2"], [], []]
    counts = values(spark, text.term_counts(text.tokens(F.col("x"))), ["b a b c b", "", None])
    assert [[(e.term, e.tf) for e in c] for c in counts] == [[("a", 1), ("b", 3), ("c", 1)], [], []]


def test_title_gate(spark):
    rows = ["sofa", "red sofa", "canon 70", "amazon gift card", "Movie poster frame", "bookcase oak", ""]
    assert values(spark, text.wants_title(F.col("x")), rows) == [False, True, False, False, False, True, False]


@pytest.mark.parametrize("answer, n, order", [
    ("[2] > [1] > [3]", 3, [2, 1, 3]), ("[2] > [9] > [2] > [4]", 4, [2, 4, 1, 3]), ("junk", 2, [1, 2]),
    (None, 2, [1, 2]), ("[1]", 0, []), ("[99999999999999999999] > [2]", 2, [2, 1]),
])
def test_permutation(spark, answer, n, order):
    got = values(spark, prompts.permutation(F.col("a"), F.col("n")), [(answer, n)], "a string, n int")
    assert got == [order]


def test_permutation_is_always_a_permutation(spark):
    rows = [(f"[{a}] > [{b}][{c}]", n) for a in range(4) for b in range(4) for c in (1, 7) for n in range(1, 5)]
    got = values(spark, F.struct("n", prompts.permutation(F.col("a"), F.col("n")).alias("o")), rows, "a string, n int")
    assert all(sorted(r.o) == list(range(1, r.n + 1)) for r in got)


def test_passages_and_summary(spark):
    long = "x" * 400
    assert values(spark, prompts.passages(F.array(F.lit("a"), F.col("x"))), [long]) == ["[1] a\n[2] " + "x" * 300]
    hit = F.struct(F.lit(0.51234).alias("score"), F.lit(None).cast("string").alias("product_class"), F.col("x").alias("text"))
    assert values(spark, prompts.hits_summary(F.array(hit)), [long]) == ["1. score=0.512 [Unknown] " + "x" * 200]
    none = F.filter(F.array(hit), lambda h: F.lit(False))
    assert values(spark, prompts.hits_summary(none), [""]) == ["No results returned by retrieval."]


def test_vectors(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    row = frame.select(vectors.l2_normalize(F.col("a")), vectors.l2_normalize(F.col("z")),
                       vectors.blend(F.col("a"), F.col("z"))).first()
    assert list(row) == [[0.6, 0.8], [0.0, 0.0], [1.5, 2.0]]
    with pytest.raises(Exception, match="expected 3 numbers, got 2"):
        frame.select(vectors.checked_dimension(F.col("a"), 3)).collect()


def test_stand_ins(spark):
    vector = values(spark, bag_of_words(F.col("x")), ["red red sofa"])[0]
    assert len(vector) == 64 and abs(sum(v * v for v in vector) - 1) < 1e-9
    rows = [("red sofa", "a red chair"), ("", "a"), ("red red", "red")]
    assert values(spark, word_overlap(F.col("q"), F.col("t")), rows, "q string, t string") == [0.5, 0.0, 1.0]


def test_calls_are_in_order_and_few_are_open():
    opened, most = [0], [0]
    lock = threading.Lock()

    def slow(batch):
        with lock:
            opened[0] += 1
            most[0] = max(most[0], opened[0])
        time.sleep(0.05 + 0.01 * (batch[0] % 3))
        with lock:
            opened[0] -= 1
        return [x * 2 for x in batch]

    start = time.perf_counter()
    found = [x for part in models.in_order(slow, models.pieces(2, list(range(48)))) for x in part]
    took = time.perf_counter() - start
    assert found == [x * 2 for x in range(48)] and most[0] == 4
    assert took < 24 * 0.06 / 2  # a quarter and some slack
    assert list(models.in_order(slow, models.pieces(2, []))) == []


def test_failed_calls_are_tried_again():
    calls = []

    def shaky(batch):
        calls.append(time.perf_counter())
        if len(calls) < 3:
            raise OSError("busy")
        return batch

    assert models.persistent(shaky, wait=0.05)([1]) == [1]
    assert calls[2] - calls[1] > 1.5 * (calls[1] - calls[0]) * 0.9
    calls.clear()
    with pytest.raises(OSError):
        models.persistent(shaky, attempts=2, wait=0.01)([1])


def test_models_keep_the_order_of_rows(spark):
    def load():
        return lambda texts: [[float(t), 1.0] for t in texts]

    def load_pairs():
        return lambda queries, texts: [float(q) - float(t) for q, t in zip(queries, texts)]

    rows = spark.range(500, numPartitions=3).select("id", F.col("id").cast("string").alias("t"))
    encode, score = models.encoder(load, batch=7, normalize=False), models.pair_scorer(load_pairs, batch=5)
    found = rows.select("id", encode("t").alias("v"), score("t", F.lit("1")).alias("s")).collect()
    assert all(r.v == [float(r.id), 1.0] and r.s == r.id - 1 for r in found) and len(found) == 500
