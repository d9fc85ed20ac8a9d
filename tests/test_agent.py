import pytest
from pyspark.sql import functions as F

from siftrank.plans import agent


def test_source_resolution(spark):
    rows = [("ESCI", "WANDS"), (None, " wands "), ("", "esci"), (None, "ebay"), (None, None)]
    frame = spark.createDataFrame(rows, "caller string, model string")
    got = [r[0] for r in frame.select(agent.resolved_source(F.col("caller"), F.col("model"))).collect()]
    assert got == ["ESCI", "WANDS", "ESCI", None, None]


@pytest.mark.parametrize("complexity, iteration, action, step", [
    ("simple", 1, "widen", "end"), ("complex", 2, "widen", "end"), ("complex", 1, "widen", "widen"),
    ("complex", 1, "return", "end"), ("complex", 1, "decompose", "decompose"), ("complex", 1, None, "end"),
])
def test_routing(spark, complexity, iteration, action, step):
    frame = spark.createDataFrame([(complexity, iteration, action)], "c string, i int, a string")
    assert frame.select(agent.route(F.col("c"), F.col("i"), F.col("a"))).first()[0] == step


def test_actions(spark):
    rows = [(q, i) for q in ("good", "low_coverage", "wrong_category", "semantic_drift", "multi_constraint_miss") for i in (1, 2)]
    frame = spark.createDataFrame(rows, "q string, i int")
    got = {(r.q, r.i): r.a for r in frame.select("q", "i", agent.action_for(F.col("q"), F.col("i")).alias("a")).collect()}
    assert {k[0] for k, v in got.items() if v == "widen"} == {"low_coverage"}
    assert {k[0] for k, v in got.items() if v == "decompose"} == {"multi_constraint_miss"}
    assert all(v == "return" for (q, i), v in got.items() if i == 2)


def test_understanding_reads_model_answers(spark):
    rows = [("1", "raw", '{"rewritten_query": " sofa couch ", "filter_source": "esci", "complexity": "complex"}'),
            ("2", "raw", '{"rewritten_query": " ", "filter_source": "", "complexity": "simple"}'), ("3", "raw", "no json"),
            ("4", "raw", None)]
    frame = spark.createDataFrame(rows, "query_id string, query string, answer string")
    got = {r.query_id: (r.rewritten_query, r.filter_source, r.complexity) for r in agent.understood(frame).collect()}
    assert got == {"1": ("sofa couch", "ESCI", "complex"), "2": ("raw", None, "simple"), "3": ("raw", None, "simple"),
                   "4": ("raw", None, "simple")}


def test_quality(spark):
    rows = [[], [0.05, 0.01], [0.9, 0.8, 0.7], [0.9, 0.2], [0.3, 0.2]]
    frame = spark.createDataFrame([(r,) for r in rows], "s array<double>")
    got = [r[0] for r in frame.select(agent.stand_in_quality(F.col("s"))).collect()]
    assert got == ["low_coverage", "low_coverage", "good", "semantic_drift", "multi_constraint_miss"]


def test_parts(spark):
    rows = [("1", "a b c", None), ("2", "a", None)]
    frame = spark.createDataFrame(rows, "query_id string, rewritten_query string, filter_source string")
    got = {(r.query_id, r.part): r.query for r in agent.stand_in_parts(frame).collect()}
    assert got == {("1", 0): "a b", ("1", 1): "c", ("2", 0): "a"}
