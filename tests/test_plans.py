"""Physical plans: what reaches the scan, what is shuffled, how the top is cut."""

import io
import re
from contextlib import redirect_stdout

from siftrank.operators import lexical
from workloads import inputs, retrieval
from __spark_entry__ import QUERIES


def plan(frame) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("simple")
    return out.getvalue()


def test_top_is_cut_before_the_shuffle(spark, sf):
    text = plan(retrieval.text_search(spark, sf).bm25(inputs.text_queries(spark, sf), 10))
    final, partial = text.index("Final"), text.index("Partial")
    between = text[final:partial]
    assert "WindowGroupLimit" in text and "Exchange hashpartitioning(query_id" in between


def test_scored_pairs_are_summed_without_a_shuffle(spark, sf):
    text = plan(retrieval.text_search(spark, sf).bm25(inputs.text_queries(spark, sf), 10))
    sums = re.search(r"HashAggregate\(keys=\[query_id.*?BroadcastHashJoin", text, re.S).group(0)
    assert "Exchange" not in sums and "SortAggregate" not in text


def test_postings_need_no_shuffle(spark, sf):
    docs = inputs.documents(spark, sf)
    text = plan(lexical.build_postings(docs, ["text"]))
    assert "Exchange" not in text and "BatchEvalPython" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["qrels_subset"](spark, sf))
    assert "PushedFilters" in text and "c_acctbal" in text
    assert "o_totalprice" not in text and "l_extendedprice" not in text


def test_no_query_joins_everything_with_everything(spark, sf):
    for name in ("bm25_single", "knn_exact", "qrels_build", "eval_ndcg", "benchmark_all", "stratified_sample",
                 "query_split", "hybrid_candidates"):
        text = plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_retrieval_stays_in_the_jvm(spark, sf):
    for name in ("bm25_single", "hybrid_rrf", "clean_query", "product_store", "eval_ndcg"):
        text = plan(QUERIES[name](spark, sf))
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


def test_stored_index_reads_the_folders_of_its_terms(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from siftrank.sources import indexes

    path = str(tmp_path / "index")
    docs = inputs.documents(spark, sf).withColumn("product_id", F.col("product_id").cast("string"))
    indexes.write_lexical(docs, ["text"], path, term_buckets=64)
    queries = spark.createDataFrame([("q", "the erhe")], "query_id string, query string")
    text = plan(lexical.bm25(indexes.read_lexical(spark, path), queries, 5, {"text": 1.0}))
    folders = re.search(r"PartitionFilters: \[term_bucket#\d+ (IN|=) .*?\]", text).group(0)
    assert folders.count(",") <= 2


def test_built_index_moves_hits_only(spark, sf):
    """Between the scan of the postings and the cut to the best per query nothing is shuffled."""
    index = lexical.build_index(inputs.documents(spark, sf), ["text"])
    queries = spark.createDataFrame([("q", "the erhe")], "query_id string, query string")
    text = plan(lexical.bm25(index, queries, 5, {"text": 1.0}))
    moved = re.findall(r"hashpartitioning\((\w+)", text)
    assert set(moved) == {"query_id"} and "Bucketed: true" in text
    assert "WindowGroupLimit" in text


def test_words_of_a_text_are_hashed_once(spark):
    """The stand-in encoder's vector is one expression, though its length is needed beside its entries."""
    from siftrank.functions.models import bag_of_words

    text = plan(spark.range(1).selectExpr("cast(id as string) AS text").select(bag_of_words("text").alias("v")))
    assert text.count("md5(") == 1 and "map_from_entries" not in text


def test_searches_by_words_encode_nothing(spark, sf, monkeypatch):
    monkeypatch.setattr(retrieval, "_text_index", retrieval._text_index.__wrapped__)
    monkeypatch.setattr(retrieval.models, "bag_of_words", None)
    for name in ("bm25_single", "bm25_filtered"):
        assert QUERIES[name](spark, sf).count() > 0


def test_buckets_follow_the_products(spark, monkeypatch):
    """Equal texts make small files; their postings and scores are as many as those of others."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lexical, "BUCKET_PRODUCTS", 1000)
    docs = spark.range(40000).select(F.col("id").cast("string").alias("product_id"), F.lit("same words").alias("text"))
    index = lexical.build_index(docs, ["text"])
    assert len(index.postings.inputFiles()) == 40
    monkeypatch.setattr(lexical, "BUCKET_BYTES", 10000)
    few = lexical.build_index(docs.limit(100).withColumn("text", F.repeat("text", 100)), ["text"])
    assert len(few.postings.inputFiles()) >= 9


def test_index_moves_texts_and_no_postings(spark, sf, monkeypatch):
    """The postings to be written come from texts dealt out by product, not from a shuffle of their own."""
    written = []
    keep = lexical.materialize_buckets

    def seen(rows, *rest):
        written.append(plan(rows))
        return keep(rows, *rest)

    monkeypatch.setattr(lexical, "materialize_buckets", seen)
    index = lexical.build_index(inputs.documents(spark, sf), ["text"])
    text = written[0]
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange hashpartitioning(product_id")
    files = index.postings.inputFiles()
    buckets = {f.rsplit("_", 1)[1] for f in files}
    assert len(buckets) == len(files) > 1  # a bucket is one file


def test_order_lines_are_sorted_in_bounded_parts(spark, sf, monkeypatch):
    """Narrow rows are few bytes; a task's share of them is bounded by their number."""
    from siftrank import scratch

    monkeypatch.setattr(scratch, "SORTED_ROWS", 100)
    lines = inputs.table(spark, sf, "lineitem").count()
    assert inputs.esci_examples(spark, sf).rdd.getNumPartitions() >= lines // 100


def test_bounded_search_shuffles_no_scored_pairs(spark):
    """Only leaders and products near the last bar leave the buckets, not every product with one of the words."""
    from pyspark.sql import functions as F

    word = lambda n, name: F.when(F.col("id") % n == 0, name).otherwise("other")
    docs = spark.range(30000).select(F.col("id").cast("string").alias("product_id"), F.concat_ws(
        " ", word(5, "a"), word(4, "b"), word(2, "c")).alias("text"))
    index = lexical.build_index(docs, ["text"])
    queries = spark.createDataFrame([("q", "a b c")], "query_id string, query string")
    found = lexical.bounded_search(index, queries, 5, {"text": 1.0}, cleaned=False)
    best = lexical.top_scores(found.scored, 1, 5).select("product_id", "score").collect()
    assert best == lexical.bm25(index, queries, 5, {"text": 1.0}, cleaned=False).select("product_id", "score").collect()
    assert found.scored.count() < 2000  # 12000 products have one of the rarer words
    for part in (found.rare, found.more):
        if part is not None:
            assert "Exchange hashpartitioning" not in plan(lexical.field_sums(part, {"text": 1.0}, 1.2, 0.75))


def test_words_are_pushed_to_the_reader(spark, tmp_path):
    """A rare word's search reads few of the postings of its folder."""
    from pyspark.sql import functions as F

    from siftrank.sources import indexes

    path = str(tmp_path / "index")
    docs = spark.range(40000).select(F.col("id").cast("string").alias("product_id"), F.lit("A").alias("source"),
                                     F.concat(F.lit("w"), "id", F.lit(" common")).alias("text"))
    indexes.write_lexical(docs, ["text"], path, term_buckets=1)
    queries = spark.createDataFrame([("q", "w777")], "query_id string, query string")
    index = indexes.read_lexical(spark, path)
    weights = lexical.term_weights(index, lexical.query_terms(queries, cleaned=False), {"text": 1.0})
    read = index.postings_of(weights)
    assert re.search(r"PushedFilters: \[[^]]*(In\(term|EqualTo\(term)", plan(read))
    assert [r.product_id for r in lexical.bm25(index, queries, 5, {"text": 1.0}, cleaned=False).collect()] == ["777"]
    scanned = read._jdf.queryExecution().executedPlan()
    assert len(read.collect()) == 1
    assert scanned_rows(scanned) <= 40000  # of 80000 postings


def scanned_rows(executed) -> int:
    """Rows that the file scans of an executed plan have given."""
    leaves = executed.collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        leaf = leaves.next()
        leaf = leaf.executedPlan() if "AdaptiveSparkPlan" in leaf.nodeName() else leaf
        if leaf.metrics().contains("numOutputRows"):
            total += leaf.metrics().apply("numOutputRows").value()
    return total
