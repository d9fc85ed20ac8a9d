import re
import threading

import pytest
from pyspark.sql import functions as F

from siftrank import scratch
from siftrank.operators import lexical
from siftrank.sources import indexes

SCHEMA = "product_id string, source string, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, n=300):
    return spark.range(n).select(F.col("id").cast("string").alias("product_id"), F.lit("A").alias("source"),
                                 F.concat(F.lit("word w"), F.col("id") % 7, F.lit(" w"), F.col("id") % 7).alias("text"))


def test_postings_carry_no_word_lists_and_are_counted_once(spark):
    rows = spark.createDataFrame([("a", "A", "red red sofa"), ("b", None, ""), ("c", "C", None)], SCHEMA)
    postings = lexical.build_postings(rows, ["text"])
    assert {tuple(r) for r in postings.collect()} == {
        ("text", "red", "a", "A", 2, 3, 0), ("text", "sofa", "a", "A", 1, 3, 1)}
    wide = lexical.build_postings(texts(spark).unionByName(rows), ["text"])
    (exploded,) = [line for line in plan(wide).splitlines() if "Generate posexplode" in line]
    carried = exploded[exploded.rindex("), ["):] if "), [" in exploded else exploded
    assert "text#" not in carried and "words" not in carried
    assert len(re.findall(r"sort_array\(", plan(wide))) == 1


def test_replaced_rows_are_counted_without_a_table_of_their_postings(spark, tmp_path, monkeypatch):
    index = indexes.create_index(texts(spark), str(tmp_path / "index"), ["text"], term_buckets=4, product_buckets=4)
    made = []
    keep = indexes.materialize
    monkeypatch.setattr(indexes, "materialize", lambda df, name, *rest: made.append(name) or keep(df, name, *rest))
    rows = spark.createDataFrame([("0", "A", "sofa"), ("1", "A", ""), ("n", "B", "w1 sofa sofa")], SCHEMA)
    after = index.upsert([rows], deleted=texts(spark).filter("product_id = '2'").select("product_id"))
    assert made and "postings_before" not in made
    fresh = lexical.build_index(after.documents(), ["text"])
    words = after.lexical()
    assert {tuple(r) for r in words.term_df().collect()} == {tuple(r) for r in fresh.term_df().collect()}
    assert [tuple(r) for r in words.field_stats().collect()] == [tuple(r) for r in fresh.field_stats().collect()]


def test_a_search_after_upserts_looks_for_replaced_rows_among_its_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "PUSHED_TERMS", 1)
    index = indexes.create_index(texts(spark), str(tmp_path / "index"), ["text"], term_buckets=1, product_buckets=4)
    index = index.upsert([texts(spark, 30).withColumn("text", F.lit("w3 sofa"))]).lexical()
    queries = spark.createDataFrame([("q", "w3 w4 sofa")], "query_id string, query string")
    weights = scratch.materialize(lexical.term_weights(index, lexical.query_terms(queries, cleaned=False), {"text": 1.0}), "weights")
    matched = lexical.match(index.postings_of(weights), weights, by_product=index.together)
    text = plan(lexical.field_sums(matched, {"text": 1.0}, 1.2, 0.75))
    # The inner of two joins is printed last: postings are cut to the terms before they meet the replaced products.
    assert text.count("REPARTITION_BY_NUM") == 1 and 0 < text.index("LeftAnti") < text.index("LeftSemi")
    found = lexical.bm25(index, queries, 400, {"text": 1.0}, cleaned=False).collect()
    alive = {r.product_id for r in index.postings.filter("term in ('w3', 'w4', 'sofa')").collect()}
    assert {r.product_id for r in found} == alive and len(found) == len(alive) == 30 + 78
    assert found[0].product_id in {str(i) for i in range(30)}


def test_independent_writes_run_side_by_side(spark, tmp_path, monkeypatch):
    met = threading.Barrier(2, timeout=60)  # broken if the calls come one after another
    assert scratch.at_once(spark, lambda: met.wait() >= 0, lambda: met.wait() >= 0) == [True, True]
    with pytest.raises(ValueError, match="no"):
        scratch.at_once(spark, lambda: 1, lambda: int("no"))
    writes, both = [], threading.Barrier(2, timeout=60)
    keep = indexes.SearchIndex._write

    def seen(self, df, name, kind, *rest, **more):
        writes.append(kind)
        if kind in ("documents", "postings"):
            both.wait()
        return keep(self, df, name, kind, *rest, **more)

    monkeypatch.setattr(indexes.SearchIndex, "_write", seen)
    indexes.create_index(texts(spark, 20), str(tmp_path / "index"), ["text"])
    assert {"documents", "postings", "terms", "fields"} == set(writes)
