import math
import random

import pytest
from pyspark.sql import functions as F

from siftrank.operators import evaluation

QRELS = [("q1", "a", 3.0), ("q1", "b", 1.0), ("q1", "c", 2.0), ("q2", "x", 1.0), ("q3", "y", 0.0), ("q4", "m", 3.0)]
RUN = [("q1", "b", 1), ("q1", "z", 2), ("q1", "a", 3), ("q2", "n", 1), ("q3", "y", 1), ("unjudged", "a", 1)]


@pytest.fixture(scope="module")
def qrels(spark):
    return spark.createDataFrame(QRELS, "query_id string, product_id string, gain double")


@pytest.fixture(scope="module")
def run(spark):
    return spark.createDataFrame(RUN, "query_id string, product_id string, rank long")


def scores(frame):
    return {(r.metric, r.k): r for r in frame.collect()}


def test_metrics_by_hand(qrels, run):
    got = scores(evaluation.evaluate(qrels, run, [2, 3]))
    dcg = 1 / math.log2(2) + 3 / math.log2(4)
    ideal = 3 + 2 / math.log2(3) + 1 / math.log2(4)
    assert got["ndcg", 3].score == pytest.approx(dcg / ideal / 4, abs=1e-6)
    assert got["ndcg", 2].score == pytest.approx(1 / (3 + 2 / math.log2(3)) / 4, abs=1e-6)
    assert got["recall", 3].score == pytest.approx((2 / 3) / 4, abs=1e-6)
    assert got["mrr", 2].score == pytest.approx(0.25, abs=1e-6)
    # q4 was not run; the unjudged query is dropped
    assert (got["mrr", 2].n_queries, got["mrr", 2].n_missing) == (4, 1)
    assert got["mrr", 2].score_answered == pytest.approx(1 / 3, abs=1e-6)


def test_threshold_and_exponential_gain(qrels, run):
    got = scores(evaluation.evaluate(qrels, run, [3], threshold=2.0, gain="exp2"))
    assert got["mrr", 3].score == pytest.approx((1 / 3) / 4, abs=1e-6)
    assert got["recall", 3].score == pytest.approx((1 / 2) / 4, abs=1e-6)
    dcg, ideal = 1 + 7 / 2, 7 + 3 / math.log2(3) + 1 / 2
    assert got["ndcg", 3].score == pytest.approx(dcg / ideal / 4, abs=1e-6)
    with pytest.raises(ValueError):
        evaluation.evaluate(qrels, run, [3], gain="cubic")


def test_perfect_run(qrels):
    got = {(r.query_id, r["rank"]): r.product_id for r in evaluation.perfect_run(qrels).collect()}
    assert [got["q1", i] for i in (1, 2, 3)] == ["a", "c", "b"]
    checked = scores(evaluation.perfect_check(qrels.filter("gain > 0"), [1, 5]))
    assert all(r.score == 1.0 for (m, _), r in checked.items() if m in ("ndcg", "mrr"))


def test_nothing_relevant_scores_zero(qrels, run):
    got = scores(evaluation.evaluate(qrels, run, [5], threshold=9.0))
    assert got["recall", 5].score == 0 and got["mrr", 5].score == 0 and got["ndcg", 5].score > 0


@pytest.mark.parametrize("ks", [[], [0], [-1], [1.5], [True]])
def test_bad_cutoffs(ks):
    with pytest.raises(ValueError):
        evaluation.checked_cutoffs(ks)


def test_cutoffs_are_sorted_once():
    assert evaluation.checked_cutoffs([20, 5, 5]) == [5, 20]


def test_run_scores(run):
    by_mode = {m: {(r.query_id, r["rank"]): r.score for r in evaluation.run_scores(run, m).collect()}
               for m in ("reciprocal_rank", "linear", "constant")}
    assert by_mode["reciprocal_rank"]["q1", 3] == pytest.approx(1 / 3)
    assert by_mode["linear"]["q1", 1] == 3.0 and by_mode["linear"]["q1", 3] == 1.0
    assert set(by_mode["constant"].values()) == {1.0}
    with pytest.raises(ValueError):
        evaluation.run_scores(run, "other")


def test_binarized_keeps_queries(qrels):
    rows = evaluation.binarized(qrels, 2.0).collect()
    assert {r.query_id for r in rows} == {"q1", "q2", "q3", "q4"} and sum(r.gain for r in rows) == 3.0


def test_compare(spark):
    rows = [("a", "ndcg", 5, 0.5), ("b", "ndcg", 5, 0.6), ("a", "mrr", 5, 0.9)]
    metrics = spark.createDataFrame(rows, "strategy string, metric string, k int, score double")
    got = evaluation.compare(metrics, baseline="a", ks=[5]).orderBy("place").collect()
    assert [(r.strategy, r.ndcg_5, r.lift) for r in got] == [("b", 0.6, 0.2), ("a", 0.5, 0.0)]


def test_several_strategies_at_once(qrels, run):
    both = run.withColumn("strategy", F.lit("one")).unionByName(run.withColumn("strategy", F.lit("two")))
    rows = evaluation.evaluate(qrels, both, [3]).collect()
    one = {(r.metric): r.score for r in rows if r.strategy == "one"}
    two = {(r.metric): r.score for r in rows if r.strategy == "two"}
    assert one == two and len(rows) == 6


def test_classes_equal_judged_pairs(spark):
    rng = random.Random(4)
    products = [(f"p{i}", rng.choice("abc")) for i in range(40)]
    queries = [(f"q{i}", rng.choice("abcd")) for i in range(12)]
    hits = [(q, p, n + 1) for q, _ in queries[:9] for n, (p, _) in enumerate(rng.sample(products, 6))]
    hits += [(q, p, n + 3) for q, p, n in hits[::5]]  # listed twice: the better place counts
    run = spark.createDataFrame(hits, "query_id string, product_id string, rank long")
    asked = spark.createDataFrame(queries, "query_id string, label string")
    table = spark.createDataFrame(products, "product_id string, label string")
    pairs = [(q, p, 1.0) for q, a in queries for p, b in products if a == b] + [(q, "none", 0.0) for q, a in queries if a == "d"]
    judged = spark.createDataFrame(pairs, "query_id string, product_id string, gain double")
    want = {(r.metric, r.k): r.score for r in evaluation.evaluate(judged, run, [2, 5]).collect()}
    found = evaluation.evaluate_classes(run, asked, table, [5, 2, 2]).collect()
    assert {(r.metric, r.k): r.score for r in found} == want
    assert [(r.metric, r.k) for r in found] == sorted(want) and {r.n_queries for r in found} == {12}


def test_metric_rows_are_in_order(qrels, run):
    rows = [(r.strategy, r.metric, r.k) for r in evaluation.evaluate(qrels, run, [3, 1, 2]).collect()]
    assert rows == sorted(rows) and len(rows) == 9


def test_shared_lists_score_like_copies(spark):
    """Lists named by two columns, of queries that were not judged, not run, or run by one strategy only."""
    rng = random.Random(8)
    judged = [(f"q{i}", f"p{p}", float(rng.randint(0, 3))) for i in range(30) for p in rng.sample(range(25), 5)]
    lists = [(s, n, some, f"p{p}", r + 1) for s, n, some in (
        [("a", n, False) for n in range(6)] + [("b", n, True) for n in range(4)] + [("none", 7, False), ("far", 1, False)])
        for r, p in enumerate(rng.sample(range(25), 8))]
    lists = [(s, n, some, f"{p} unjudged" if s == "b" and n == 2 else p, r + 90 if s == "far" else r)
             for s, n, some, p, r in lists]
    lists += [(s, n, some, p, r + 2) for s, n, some, p, r in lists[::6]]  # listed twice: the better place counts
    asked = [(f"q{i}", i % 6, False) for i in range(3, 40)] + [(f"q{i}", i % 4, True) for i in range(10, 35)]
    asked += [("q5", 2, False)]  # a query with two lists
    qrels = spark.createDataFrame(judged, "query_id string, product_id string, gain double")
    shared = spark.createDataFrame(lists, "strategy string, list int, some boolean, product_id string, rank long")
    ids = spark.createDataFrame(asked, "query_id string, list int, some boolean")
    copies = ids.join(shared, ["list", "some"]).select("strategy", "query_id", "product_id", "rank")
    copies = copies.unionByName(spark.createDataFrame([("none", "nobody", "p1", 1)], copies.schema))
    for options in ({}, {"threshold": 2.0, "gain": "exp2"}):
        want = evaluation.evaluate(qrels, copies, [2, 5], **options).collect()
        assert evaluation.evaluate(qrels, shared, [2, 5], ids=ids, **options).collect() == want
    assert len(want) == 24 and {r.strategy: r.n_missing for r in want} == {"a": 3, "b": 10, "far": 30, "none": 30}
