"""Index tables, retrieval strategies and the agent's steps over the given tables."""

from __future__ import annotations

from dataclasses import replace
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.fixed_values import FIELD_BOOSTS
from siftrank.functions import models, prompts
from siftrank.functions.text import clean_query, wants_title
from siftrank.functions.vectors import blend, l2_normalize
from siftrank.operators import dense, fusion, lexical, rerank
from siftrank.operators.curation import build_queries
from siftrank.plans import agent
from siftrank.plans.strategies import Search, distinct_texts, for_all, with_payload
from siftrank.scratch import materialize, scratch_path, spread
from siftrank.sources import indexes
from workloads import inputs, sql
from workloads.registry import query

TEXT_BOOST = {"text": 1.0}
K = 10
POOL = 25
DIMENSION = 64


@cache
def _text_index(application: str, sf: str) -> lexical.LexicalIndex:
    return lexical.build_index(inputs.documents(SparkSession.getActiveSession(), sf), ["text"])


def text_index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    """Words of the documents, built once per application and folder; queries by words alone read no vectors."""
    return _text_index(spark.sparkContext.applicationId, sf)


@cache
def _text_search(application: str, sf: str) -> Search:
    spark = SparkSession.getActiveSession()
    docs = inputs.documents(spark, sf)
    vectors = materialize(spread(docs).select(
        "product_id", "source", models.bag_of_words(F.col("text"), DIMENSION).alias("embedding")
    ), "vectors")
    return Search(_text_index(application, sf), vectors, docs.select("product_id", "text"), TEXT_BOOST)


def text_search(spark: SparkSession, sf: str) -> Search:
    """Index tables of the documents, built once per application and folder."""
    return _text_search(spark.sparkContext.applicationId, sf)


@cache
def _shop_documents(application: str, sf: str) -> DataFrame:
    return materialize(inputs.shop_documents(SparkSession.getActiveSession(), sf), "shop-documents")


@cache
def _shop_index(application: str, sf: str) -> lexical.LexicalIndex:
    return lexical.build_index(_shop_documents(application, sf), list(FIELD_BOOSTS))


def shop_index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    """Words of the parts, built once per application and folder; queries by words alone read no vectors."""
    return _shop_index(spark.sparkContext.applicationId, sf)


@cache
def _shop_search(application: str, sf: str) -> Search:
    docs = _shop_documents(application, sf)
    vectors = materialize(spread(docs).select(
        "product_id", "source", models.bag_of_words(F.col("encode_text"), DIMENSION).alias("embedding")
    ), "vectors")
    texts = docs.select("product_id", F.coalesce(F.nullif("encode_text", F.lit("")), "full_text").alias("text"))
    return Search(_shop_index(application, sf), vectors, texts, FIELD_BOOSTS)


def shop_search(spark: SparkSession, sf: str) -> Search:
    """Index tables of the parts, built once per application and folder."""
    return _shop_search(spark.sparkContext.applicationId, sf)


def hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", "product_id", "score", "rank")


HITS = "SELECT query_id, product_id, score, rank FROM {}"
WORD_DOCS = sql.word_vectors("doc_vectors", "docs", "product_id, source", "text")
SHOP_DOCS = sql.word_vectors("doc_vectors", "shop", "product_id, source", "encode_text")
ASKED_VECTORS = sql.word_vectors("asked_vectors", "asked", "query_id", "query")
TEXTS = "texts AS (SELECT doc_id AS product_id, text FROM documents)"
SHOP_TEXTS = "texts AS (SELECT product_id, encode_text AS text FROM shop)"
TEXT_LEGS = [sql.DOCUMENTS, sql.TEXT_QUERIES, sql.bm25(TEXT_BOOST, 50), WORD_DOCS, ASKED_VECTORS,
             sql.knn(50, "doc_vectors", "asked_vectors")]
SHOP_LEGS = [*sql.SHOP_PRODUCTS, sql.SHOP_FIELDS, sql.SHOP_QUERIES, sql.bm25(FIELD_BOOSTS, 50),
             SHOP_DOCS, ASKED_VECTORS, sql.knn(50, "doc_vectors", "asked_vectors")]


@query("bm25_index_stats", sql.with_ctes(sql.DOCUMENTS, sql.TEXT_QUERIES, sql.bm25(TEXT_BOOST, 1), """
SELECT term, df, n_docs, round(avgdl, 6) AS avgdl, total
FROM (SELECT field, term, CAST(sum(tf) AS BIGINT) AS total FROM postings GROUP BY ALL)
JOIN frequency USING (field, term) JOIN stats USING (field)"""))
def bm25_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "lexical-index")
    indexes.write_lexical(inputs.documents(spark, sf), ["text"], path, term_buckets=16)
    index = indexes.read_lexical(spark, path)
    totals = index.postings.groupBy("field", "term").agg(F.sum("tf").alias("total")).join(
        index.term_df(), ["field", "term"]
    )
    return totals.join(F.broadcast(index.field_stats()), "field").select(
        "term", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"), "total"
    )


@query("vector_index", sql.with_ctes(*sql.SHOP_PRODUCTS, SHOP_DOCS, """
SELECT v.product_id, v.source, CAST(b AS INTEGER) AS place,
       round(embedding[b + 1] / sqrt(list_sum(list_transform(embedding, lambda x: x * x))), 6) AS value
FROM doc_vectors v, range(64) AS r(b)"""))
def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "vector-index")
    docs = spread(inputs.shop_documents(spark, sf))
    indexes.write_vectors(indexes.vector_rows(docs, models.bag_of_words, DIMENSION), path)
    return indexes.read_vectors(spark, path).select(
        "product_id", "source", F.posexplode("embedding").alias("place", "value")
    ).withColumn("value", F.round("value", 6))


@query("bm25_single", sql.with_ctes(sql.DOCUMENTS, sql.TEXT_QUERIES, sql.bm25(TEXT_BOOST, K), HITS.format("lexical")))
def bm25_single(spark: SparkSession, sf: str) -> DataFrame:
    return hits(lexical.bm25(text_index(spark, sf), inputs.text_queries(spark, sf), K, TEXT_BOOST))


@query("bm25_bounded", sql.with_ctes(sql.DOCUMENTS, sql.TEXT_QUERIES, sql.bm25(TEXT_BOOST, K), HITS.format("lexical")))
def bm25_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """The hits of ``bm25_single``; common words are looked up only for products that can still enter."""
    return hits(lexical.bm25_bounded(text_index(spark, sf), inputs.text_queries(spark, sf), K, TEXT_BOOST))


@query("bm25_bounded_fields", sql.with_ctes(
    *sql.SHOP_PRODUCTS, sql.SHOP_FIELDS, sql.SHOP_QUERIES, sql.bm25(FIELD_BOOSTS, 20), HITS.format("lexical")))
def bm25_bounded_fields(spark: SparkSession, sf: str) -> DataFrame:
    return hits(lexical.bm25_bounded(shop_index(spark, sf), inputs.shop_queries(spark, sf), 20, FIELD_BOOSTS))


@query("bm25_stored_index", sql.with_ctes(
    sql.DOCUMENTS, sql.TEXT_QUERIES, sql.bm25(TEXT_BOOST, K),
    "SELECT query_id, CAST(product_id AS BIGINT) AS product_id, score, rank FROM lexical"))
def bm25_stored_index(spark: SparkSession, sf: str) -> DataFrame:
    """Search in an index on disk, reading the folders of the queries' terms."""
    path = scratch_path(spark, "lexical-index")
    padded = inputs.documents(spark, sf).withColumn("product_id", F.lpad(F.col("product_id").cast("string"), 12, "0"))
    indexes.write_lexical(padded, ["text"], path, term_buckets=64)
    found = lexical.bm25(indexes.read_lexical(spark, path), inputs.text_queries(spark, sf), K, TEXT_BOOST)
    return found.select("query_id", F.col("product_id").cast("bigint").alias("product_id"), "score", "rank")


@query("bm25_multifield", sql.with_ctes(
    *sql.SHOP_PRODUCTS, sql.SHOP_FIELDS, sql.SHOP_QUERIES, sql.bm25(FIELD_BOOSTS, 20), HITS.format("lexical")))
def bm25_multifield(spark: SparkSession, sf: str) -> DataFrame:
    return hits(lexical.bm25(shop_index(spark, sf), inputs.shop_queries(spark, sf), 20, FIELD_BOOSTS))


@query("bm25_filtered", sql.with_ctes(
    sql.DOCUMENTS, sql.TEXT_QUERIES, sql.bm25(TEXT_BOOST, K, source="src3"), HITS.format("lexical")))
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return hits(lexical.bm25(text_index(spark, sf), inputs.text_queries(spark, sf), K, TEXT_BOOST,
                             filter_source="src3"))


@query("bm25_customers", sql.with_ctes(
    *sql.SHOP_PRODUCTS, sql.SHOP_FIELDS, sql.EXAMPLES, """
asked AS (SELECT query_id, query FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY row_no, product_id) AS r FROM examples) WHERE r = 1)""",
    sql.bm25(FIELD_BOOSTS, K), HITS.format("lexical")))
def bm25_customers(spark: SparkSession, sf: str) -> DataFrame:
    texts, ids = distinct_texts(customer_queries(spark, sf))
    return hits(for_all(lexical.bm25(shop_index(spark, sf), texts.drop("filter_source"), K, FIELD_BOOSTS), ids))


def customer_queries(spark: SparkSession, sf: str) -> DataFrame:
    return build_queries(inputs.shop_judged(spark, sf), prefix="", order=[F.asc(c) for c in inputs.ESCI_ORDER])


VECTORS = "vectors AS (SELECT vec_id AS product_id, 'label' || label AS source, embedding FROM embeddings)"
VECTOR_QUERIES = "wanted AS (SELECT vec_id AS query_id, embedding FROM embeddings)"


@query("knn_exact", sql.with_ctes(
    VECTORS, VECTOR_QUERIES, sql.knn(K, "vectors", "wanted"), HITS.format("dense")))
def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    return hits(dense.knn(inputs.vectors(spark, sf), inputs.vector_queries(spark, sf), K))


@query("knn_blocks", sql.with_ctes(
    VECTORS, VECTOR_QUERIES, sql.knn(K, "vectors", "wanted"), HITS.format("dense")))
def knn_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The join of blocks that serves query sets too large to send to every task."""
    return hits(dense.knn(inputs.vectors(spark, sf), inputs.vector_queries(spark, sf), K, chunk_bytes=4096))


@query("knn_postfilter", sql.with_ctes(
    VECTORS, VECTOR_QUERIES, sql.knn(K, "vectors", "wanted"), HITS.format("dense") + " WHERE source = 'label3'"))
def knn_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    return hits(dense.knn(inputs.vectors(spark, sf), inputs.vector_queries(spark, sf), K, filter_source="label3"))


@query("knn_prefilter", sql.with_ctes(
    VECTORS, VECTOR_QUERIES, sql.knn(K, "vectors", "wanted", where="source = 'label3'"), HITS.format("dense")))
def knn_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return hits(dense.knn(inputs.vectors(spark, sf), inputs.vector_queries(spark, sf), K,
                          filter_source="label3", filter_mode="pre"))


@query("knn_ivf", sql.with_ctes(VECTORS, VECTOR_QUERIES, """
centers AS (SELECT row_number() OVER (ORDER BY label) AS cell, CAST(embedding AS DOUBLE[]) AS center FROM (
  SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label))""", """
near AS (SELECT vec_id, cell, row_number() OVER (
    PARTITION BY vec_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), center) DESC, cell) AS place
  FROM embeddings, centers)""",
    sql.knn(K, "vectors", "wanted", where="""EXISTS (
      SELECT 1 FROM near a JOIN near b USING (cell)
      WHERE a.vec_id = p.product_id AND a.place = 1 AND b.vec_id = q.query_id AND b.place <= 4)"""),
    HITS.format("dense")))
def knn_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the first vector of each label; a query reads its four nearest cells."""
    rows = inputs.table(spark, sf, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).orderBy("label")  # one per label
    centers = np.array([r["v"] for r in first.collect()], dtype=np.float64)
    return hits(dense.knn_cells(inputs.vectors(spark, sf), inputs.vector_queries(spark, sf), K, centers=centers,
                                rows_per_block=200))


@query("knn_all_cells", sql.with_ctes(
    VECTORS, VECTOR_QUERIES, sql.knn(K, "vectors", "wanted"), HITS.format("dense")))
def knn_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """With every cell probed the cell search is exact; a cell is split in blocks of few rows."""
    return hits(dense.knn_cells(inputs.vectors(spark, sf), inputs.vector_queries(spark, sf), K, cells=8, probes=8,
                                rows_per_block=50))


@query("knn_codes_recall", """
SELECT 'label' || label AS source, count(*) AS queries, true AS reached, true AS exact_scores FROM embeddings GROUP BY label""")
def knn_codes_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Search in codes of 16 bytes beside the exact search: at least nine of ten neighbours in each group of queries."""
    vectors, queries = inputs.vectors(spark, sf), inputs.vector_queries(spark, sf)
    book = dense.train_codes(vectors)
    codes = materialize(dense.code_table(vectors, book), "codes")
    found = dense.knn_codes(codes, book, vectors, queries, K).select("query_id", "product_id", F.col("score").alias("_score"))
    both = dense.knn(vectors, queries, K).join(found, ["query_id", "product_id"], "left")
    groups = vectors.select(F.col("product_id").alias("query_id"), F.col("source").alias("group"))
    return both.join(groups, "query_id").groupBy(F.col("group").alias("source")).agg(
        F.count_distinct("query_id").alias("queries"), (F.count("_score") >= 0.9 * F.count(F.lit(1))).alias("reached"),
        F.coalesce(F.max(F.abs(F.col("score") - F.col("_score"))) < 2e-6, F.lit(False)).alias("exact_scores"))


@query("hybrid_candidates", sql.with_ctes(
    *TEXT_LEGS, sql.candidates(POOL), "SELECT query_id, product_id, score, source, leg, rank FROM found"))
def hybrid_candidates(spark: SparkSession, sf: str) -> DataFrame:
    search, queries = text_search(spark, sf), inputs.text_queries(spark, sf)
    return fusion.candidates(*search.legs(queries, search.encoded(queries), POOL))


@query("rrf", sql.with_ctes(
    VECTORS, VECTOR_QUERIES, sql.knn(K, "vectors", "wanted"), sql.knn(K, "vectors", "wanted", "other",
                                                                       "source = 'label3'"),
    sql.rrf(K, "fused", "SELECT query_id, product_id, rank FROM dense UNION ALL SELECT query_id, product_id, rank FROM other"),
    HITS.format("fused")))
def rrf(spark: SparkSession, sf: str) -> DataFrame:
    vectors, queries = inputs.vectors(spark, sf), inputs.vector_queries(spark, sf)
    runs = [dense.knn(vectors, queries, K),
            dense.knn(vectors, queries, K, filter_source="label3", filter_mode="pre")]
    return hits(fusion.rrf(runs, K))


BOTH = "SELECT query_id, product_id, rank FROM lexical UNION ALL SELECT query_id, product_id, rank FROM dense"


@query("hybrid_rrf", sql.with_ctes(*TEXT_LEGS, sql.rrf(K, "fused", BOTH), HITS.format("fused")))
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return hits(text_search(spark, sf).hybrid_rrf(inputs.text_queries(spark, sf), K))


@query("search_hits", sql.with_ctes(
    *sql.SHOP_PRODUCTS, sql.SHOP_FIELDS, sql.SHOP_QUERIES, sql.bm25(FIELD_BOOSTS, K),
    "SELECT query_id, product_id, score, rank, brand, full_text FROM lexical JOIN shop USING (product_id)"))
def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.bm25(shop_index(spark, sf), inputs.shop_queries(spark, sf), K, FIELD_BOOSTS)
    return with_payload(found, inputs.shop_documents(spark, sf)).select(
        "query_id", "product_id", "score", "rank", "brand", "full_text"
    )


@query("hybrid_rerank", sql.with_ctes(
    *TEXT_LEGS, TEXTS, sql.candidates(POOL), sql.rerank(K, "reranked", "texts"), HITS.format("reranked")))
def hybrid_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return hits(text_search(spark, sf).hybrid_rerank(inputs.text_queries(spark, sf), K))


@query("hybrid_rerank_shop", sql.with_ctes(
    *SHOP_LEGS, SHOP_TEXTS, sql.candidates(POOL), sql.rerank(K, "reranked", "texts"), HITS.format("reranked")))
def hybrid_rerank_shop(spark: SparkSession, sf: str) -> DataFrame:
    return hits(shop_search(spark, sf).hybrid_rerank(inputs.shop_queries(spark, sf), K))


@query("hybrid_rerank_missing_text", sql.with_ctes(
    *TEXT_LEGS, "texts AS (SELECT doc_id AS product_id, text FROM documents WHERE doc_id % 3 <> 0)", sql.candidates(POOL),
    sql.rerank(K, "reranked", "texts", join="LEFT JOIN"), HITS.format("reranked")))
def hybrid_rerank_missing_text(spark: SparkSession, sf: str) -> DataFrame:
    """A candidate whose text is not known is scored by an empty one and stays."""
    search = text_search(spark, sf)
    some = replace(search, texts=search.texts.filter("product_id % 3 <> 0"))
    return hits(some.hybrid_rerank(inputs.text_queries(spark, sf), K))


@query("listwise_rerank", sql.with_ctes(
    *TEXT_LEGS, TEXTS, sql.candidates(POOL), sql.listwise(K, "listed", "texts"), HITS.format("listed")))
def listwise_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return hits(text_search(spark, sf).hybrid_listwise(inputs.text_queries(spark, sf), K, POOL))


TITLE_VECTORS = [f"""
titled AS (
  SELECT query_id, query, NOT (regexp_matches(lower(query), '{sql.fixed.NO_TITLE_FOR}')
    OR len(list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '')) <= 1) AS wanted,
    array_to_string(list_distinct({sql.tokens(sql.clean_query('query'))}), ' ') AS title FROM asked)""",
    sql.word_vectors("title_words", "titled", "query_id, wanted", "title"), """
asked_unit AS (SELECT query_id, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding,
               lambda y: y * y)))) AS unit FROM asked_vectors)""", """
title_unit AS (SELECT query_id, wanted, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding,
               lambda y: y * y)))) AS unit FROM title_words)""", """
mixed AS (
  SELECT a.query_id, CASE WHEN t.wanted THEN list_transform(list_zip(a.unit, t.unit),
                          lambda p: 0.5e0 * p[1] + 0.5e0 * p[2]) ELSE a.unit END AS embedding
  FROM asked_unit a LEFT JOIN title_unit t USING (query_id))"""]


def titled_legs(legs: list[str]) -> list[str]:
    return [*legs[:-1], *TITLE_VECTORS, sql.knn(50, "doc_vectors", "mixed")]


@query("hyde_rerank", sql.with_ctes(
    *titled_legs(TEXT_LEGS), TEXTS, sql.candidates(POOL), sql.rerank(K, "reranked", "texts"), HITS.format("reranked")))
def hyde_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return hits(text_search(spark, sf).hyde_rerank(inputs.text_queries(spark, sf), K))


@query("hyde_listwise", sql.with_ctes(
    *titled_legs(TEXT_LEGS), TEXTS, sql.candidates(POOL), sql.listwise(K, "listed", "texts"), HITS.format("listed")))
def hyde_listwise(spark: SparkSession, sf: str) -> DataFrame:
    return hits(text_search(spark, sf).hyde_listwise(inputs.text_queries(spark, sf), K, POOL))


OPENINGS = """CASE turn % 4 WHEN 0 THEN 'I''m looking for some ' WHEN 2 THEN '  Can you show me a GREAT ' ELSE '' END"""


def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn as a query, some with a conversational opening."""
    rows = inputs.table(spark, sf, "conversations").filter("role = 'user'")
    opening = F.when(F.col("turn") % 4 == 0, "I'm looking for some ").when(
        F.col("turn") % 4 == 2, "  Can you show me a GREAT ").otherwise("")
    return rows.select("conv_id", "turn", F.concat(opening, "text").alias("query"))


ASKED_TURNS = f"(SELECT conv_id, turn, {OPENINGS} || text AS query FROM conversations WHERE role = 'user')"


@query("clean_query", f"SELECT conv_id, turn, {sql.clean_query('query')} AS cleaned FROM {ASKED_TURNS}")
def clean_queries(spark: SparkSession, sf: str) -> DataFrame:
    return user_turns(spark, sf).select("conv_id", "turn", clean_query(F.col("query")).alias("cleaned"))


@query("clean_query_legacy",
       f"SELECT conv_id, turn, {sql.clean_query('query', sql.fixed.LEAD_INS_LEGACY)} AS cleaned FROM {ASKED_TURNS}")
def clean_queries_legacy(spark: SparkSession, sf: str) -> DataFrame:
    return user_turns(spark, sf).select("conv_id", "turn", clean_query(F.col("query"), legacy=True).alias("cleaned"))


@query("hyde_gate", f"""
SELECT product_id, NOT (regexp_matches(query, '(?i){sql.fixed.NO_TITLE_FOR}')
       OR len(list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '')) <= 1) AS wanted
FROM (SELECT p_partkey AS product_id, CASE p_size % 5 WHEN 0 THEN p_name || ' ' || p_size WHEN 1 THEN p_type
      WHEN 2 THEN p_name || ' Amazon' ELSE p_name END AS query FROM part)""")
def hyde_gate(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""CASE p_size % 5 WHEN 0 THEN p_name || ' ' || p_size WHEN 1 THEN p_type
                     WHEN 2 THEN p_name || ' Amazon' ELSE p_name END""")
    return inputs.table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), wants_title(text).alias("wanted")
    )


@query("hyde_blend", """
SELECT vec_id, CAST(b AS INTEGER) AS place, round(0.5e0 * a.embedding[b + 1] + 0.5e0 * c.embedding[b + 1], 6) AS value
FROM embeddings a JOIN (SELECT label, embedding FROM embeddings WHERE vec_id IN (
  SELECT min(vec_id) FROM embeddings GROUP BY label)) c USING (label), range(64) AS r(b)""")
def hyde_blend(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.table(spark, sf, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("other"))
    return rows.join(first, "label").select(
        "vec_id", F.posexplode(blend(F.col("embedding"), F.col("other"))).alias("place", "value")
    ).withColumn("value", F.round("value", 6))


@query("l2_normalize", """
SELECT vec_id, CAST(b AS INTEGER) AS place, round(v[b + 1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS value
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 2)) AS v FROM embeddings),
     range(64) AS r(b)""")
def l2_normalized(spark: SparkSession, sf: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2))
    return inputs.table(spark, sf, "embeddings").select("vec_id", scaled.alias("v")).select(
        "vec_id", F.posexplode(l2_normalize(F.col("v"))).alias("place", "value")
    ).withColumn("value", F.round("value", 6))


ANSWER = "'[' || p_size || '] > [2] > [x] > [' || (p_partkey % 7) || '] > [2]'"


@query("parse_permutation", f"""
SELECT p_partkey, array_to_string(kept || list_filter(range(1, n + 1), lambda i: NOT list_contains(kept, i)), ',') AS places
FROM (SELECT p_partkey, n, list_filter(said, lambda x, i: list_position(said, x) = i AND x BETWEEN 1 AND n) AS kept
      FROM (SELECT p_partkey, p_size % 6 AS n, [CAST(p_size AS BIGINT), 2, p_partkey % 7] AS said FROM part))""")
def parse_permutation(spark: SparkSession, sf: str) -> DataFrame:
    order = prompts.permutation(F.expr(ANSWER), F.col("p_size") % 6)
    return inputs.table(spark, sf, "part").select("p_partkey", F.array_join(order, ",").alias("places"))


@query("rerank_prompt", sql.with_ctes(*TEXT_LEGS, TEXTS, sql.candidates(50), """
listed AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY leg, rank) AS n, substr(text, 1, 300) AS passage
  FROM found JOIN texts USING (product_id))""", """
SELECT query_id, 'Rank the ' || count(*) || ' numbered products by how well they match the query: ' || any_value(a.query)
  || chr(10) || chr(10) || string_agg('[' || n || '] ' || passage, chr(10) ORDER BY n) || chr(10) || chr(10)
  || 'Answer with all ' || count(*) || ' identifiers, best first, in the form [2] > [1] > [3].' AS prompt
FROM listed JOIN asked a USING (query_id) GROUP BY query_id"""))
def rerank_prompt(spark: SparkSession, sf: str) -> DataFrame:
    search, queries = text_search(spark, sf), inputs.text_queries(spark, sf)
    found = search.found(queries, search.legs(queries, search.encoded(queries), 50), 50)
    return rerank.listwise_prompts(found).select("query_id", "prompt")


@query("hits_summary", sql.with_ctes(
    sql.DOCUMENTS, sql.TEXT_QUERIES, sql.bm25(TEXT_BOOST, K), TEXTS, """
SELECT query_id, coalesce(string_agg(rank || '. score=' || printf('%.3f', score) || ' [' || source || '] '
       || substr(text, 1, 200), chr(10) ORDER BY rank), 'No results returned by retrieval.') AS summary
FROM asked LEFT JOIN (SELECT * FROM lexical JOIN texts USING (product_id) WHERE rank <= 5) USING (query_id)
GROUP BY query_id"""))
def hits_summaries(spark: SparkSession, sf: str) -> DataFrame:
    search, queries = text_search(spark, sf), inputs.text_queries(spark, sf)
    texts = inputs.documents(spark, sf).select("product_id", "text", F.col("source").alias("product_class"))
    found = materialize(search.bm25(queries, K), "hits")
    return agent.with_hits(queries, found, texts).select("query_id", F.col("hits_summary").alias("summary"))


SAID = "CASE p_size % 4 WHEN 0 THEN ' esci ' WHEN 1 THEN 'WANDS' WHEN 2 THEN 'ebay' ELSE NULL END"
CALLER = "CASE WHEN p_type = 'PROMO' THEN 'ESCI' WHEN p_type = 'SMALL' THEN '' END"


@query("resolve_source", f"""
SELECT p_partkey, coalesce(nullif({CALLER}, ''), CASE WHEN upper(trim({SAID})) IN ('ESCI', 'WANDS')
       THEN upper(trim({SAID})) END) AS source FROM part""")
def resolve_source(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "part").select(
        "p_partkey", agent.resolved_source(F.expr(CALLER), F.expr(SAID)).alias("source")
    )


QUALITY = """CASE p_size % 6 WHEN 0 THEN 'good' WHEN 1 THEN 'low_coverage' WHEN 2 THEN 'wrong_category'
             WHEN 3 THEN 'semantic_drift' WHEN 4 THEN 'multi_constraint_miss' ELSE 'other' END"""
STATE = f"""(SELECT p_partkey, {QUALITY} AS quality, 1 + p_partkey % 2 AS iteration,
             CASE WHEN p_type = 'SMALL' THEN 'simple' ELSE 'complex' END AS complexity FROM part)"""
ACTION = """CASE WHEN iteration >= 2 THEN 'return' WHEN quality IN ('good', 'wrong_category', 'semantic_drift') THEN 'return'
            WHEN quality = 'low_coverage' THEN 'widen' WHEN quality = 'multi_constraint_miss' THEN 'decompose'
            ELSE 'return' END"""


def agent_state(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "part").select(
        "p_partkey", F.expr(QUALITY).alias("quality"), F.expr("1 + p_partkey % 2").alias("iteration"),
        F.expr("CASE WHEN p_type = 'SMALL' THEN 'simple' ELSE 'complex' END").alias("complexity"),
    )


@query("assess_rules", f"SELECT p_partkey, {ACTION} AS action FROM {STATE}")
def assess_rules(spark: SparkSession, sf: str) -> DataFrame:
    return agent_state(spark, sf).select(
        "p_partkey", agent.action_for(F.col("quality"), F.col("iteration")).alias("action")
    )


@query("agent_route", f"""
SELECT p_partkey, CASE WHEN complexity = 'simple' OR iteration >= 2 OR quality IN ('good', 'wrong_category',
       'semantic_drift', 'other') THEN 'end' WHEN quality = 'low_coverage' THEN 'widen' ELSE 'decompose' END AS next
FROM {STATE}""")
def agent_route(spark: SparkSession, sf: str) -> DataFrame:
    action = agent.action_for(F.col("quality"), F.col("iteration"))
    return agent_state(spark, sf).select(
        "p_partkey", agent.route(F.col("complexity"), F.col("iteration"), action).alias("next")
    )


PARTS = """
parts AS (
  SELECT query_id AS whole, part, array_to_string(words[part * h + 1 : CASE part WHEN 0 THEN h ELSE len(words) END], ' ')
           AS query
  FROM (SELECT query_id, words, CAST(ceil(len(words) / 2) AS BIGINT) AS h FROM (
    SELECT query_id, {words} AS words FROM {rows})), (VALUES (0), (1)) AS p(part)),
asked_parts AS (SELECT whole || '#' || part AS query_id, whole, part, query FROM parts WHERE query <> '')"""


def merged_parts(k: int, found: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT query_id, product_id, source, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, part, place) AS rank FROM (
      SELECT whole AS query_id, product_id, r.source, r.score, part, r.rank AS place,
             row_number() OVER (PARTITION BY whole, product_id ORDER BY r.score DESC, part, r.rank) AS first_row
      FROM {found} r JOIN asked_parts USING (query_id)) WHERE first_row = 1) WHERE rank <= {k})"""


@query("decompose_merge", sql.with_ctes(
    *sql.SHOP_PRODUCTS, sql.SHOP_FIELDS, sql.SHOP_QUERIES,
    PARTS.format(words=sql.tokens("query"), rows="asked"),
    sql.bm25(FIELD_BOOSTS, 2 * K, "lexical", "asked_parts"), merged_parts(K, "lexical", "merged"), HITS.format("merged")))
def decompose_merge(spark: SparkSession, sf: str) -> DataFrame:
    state = inputs.shop_queries(spark, sf).select(
        "query_id", F.col("query").alias("rewritten_query"), F.lit(None).cast("string").alias("filter_source")
    )
    parts = materialize(agent.stand_in_parts(state).withColumn("whole", F.col("query_id")).withColumn(
        "query_id", F.concat_ws("#", "whole", "part")), "parts")
    found = lexical.bm25(shop_index(spark, sf), parts.select("query_id", "query"), 2 * K, FIELD_BOOSTS)
    whole = found.join(parts.select("query_id", "whole", "part"), "query_id").drop("query_id")
    return hits(rerank.best_of_subqueries(whole.withColumnRenamed("whole", "query_id"), K))


UNDERSTOOD = f"""
understood AS (
  SELECT query_id, query, coalesce(nullif({sql.strip(sql.clean_query('query'))}, ''), query) AS rewritten_query,
         CASE WHEN regexp_matches(lower(query), '\\b(amazon|esci)\\b') THEN 'ESCI'
              WHEN regexp_matches(lower(query), '\\b(wayfair|wands)\\b') THEN 'WANDS' END AS filter_source,
         CASE WHEN len(list_distinct({sql.tokens('query')})) >= 4 THEN 'complex' ELSE 'simple' END AS complexity
  FROM asked)"""

NAMED = """asked AS (
  SELECT DISTINCT p_name || ' ' || p_size % 4 AS query_id, CASE p_size % 4 WHEN 0 THEN p_name
         WHEN 1 THEN p_name || ' from Amazon' WHEN 2 THEN 'wayfair ' || p_name
         ELSE 'Hi ' || p_name || ' with large old plate' END AS query FROM part)"""


def named_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as asked in four ways."""
    return inputs.table(spark, sf, "part").select(
        F.expr("p_name || ' ' || p_size % 4").alias("query_id"),
        F.expr("""CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' from Amazon'
                  WHEN 2 THEN 'wayfair ' || p_name ELSE 'Hi ' || p_name || ' with large old plate' END""").alias("query"),
    ).distinct()


ANSWERS = """CASE l_linenumber % 6
    WHEN 0 THEN '{"rewritten_query": " ' || l_returnflag || ' rug ", "filter_source": "esci", "complexity": "complex"}'
    WHEN 1 THEN '{"rewritten_query": "  ", "filter_source": "nowhere", "complexity": "hard"}'
    WHEN 2 THEN 'I would search for ' || l_returnflag WHEN 3 THEN '{"rewritten_query": "cut off'
    WHEN 4 THEN '{"complexity": "complex", "filter_source": " Wands "}' END"""
ASKED_LINES = f"""(SELECT l_orderkey * 8 + l_linenumber AS query_id, l_linestatus || ' item' AS query,
  CASE WHEN l_quantity > 25 THEN 'ESCI' WHEN l_quantity > 20 THEN '' END AS caller, l_linenumber % 6 AS kind, l_returnflag,
  {ANSWERS} AS answer FROM lineitem)"""


@query("understand_query", f"""
SELECT query_id, query, CASE kind WHEN 0 THEN l_returnflag || ' rug' ELSE query END AS rewritten_query,
       coalesce(nullif(caller, ''), CASE kind WHEN 0 THEN 'ESCI' WHEN 4 THEN 'WANDS' END) AS filter_source,
       CASE WHEN kind IN (0, 4) THEN 'complex' ELSE 'simple' END AS complexity
FROM {ASKED_LINES}""")
def understand_query(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of all kinds a model gives: full, blank, prose, cut off, partial and none."""
    rows = inputs.table(spark, sf, "lineitem")
    asked = rows.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("query_id"), F.expr("l_linestatus || ' item'").alias("query"),
        F.expr("CASE WHEN l_quantity > 25 THEN 'ESCI' WHEN l_quantity > 20 THEN '' END").alias("filter_source"),
        F.expr(ANSWERS).alias("answer"))
    return agent.understood(asked)


@query("agent_rewrites", sql.with_ctes(NAMED, UNDERSTOOD, "SELECT * FROM understood"))
def agent_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """The queries that the agent searches with its deterministic stand-in."""
    return agent.stand_in_understanding(named_queries(spark, sf))


def agent_round(name: str, rows: str, pool: int, k: int) -> list[str]:
    """One retrieval of the agent: both legs under the query's source, union, rerank."""
    lexical_name, dense_name = f"{name}_lexical", f"{name}_dense"
    return [
        f"{name}_all AS (SELECT query_id, query FROM {rows})",
        sql.bm25(FIELD_BOOSTS, 10 ** 9, f"{name}_open", f"{name}_all", tables=False),
        f"""{lexical_name} AS (SELECT query_id, product_id, source, score, rank FROM (
  SELECT o.query_id, product_id, source, score,
         row_number() OVER (PARTITION BY o.query_id ORDER BY score DESC, product_id) AS rank
  FROM {name}_open o JOIN {rows} r ON r.query_id = o.query_id
  WHERE r.filter_source IS NULL OR r.filter_source = source) WHERE rank <= {pool})""",
        sql.word_vectors(f"{name}_vectors", f"{name}_all", "query_id", "query"),
        sql.knn(pool, "doc_vectors", f"{name}_vectors", f"{name}_near"),
        f"""{dense_name} AS (SELECT n.* FROM {name}_near n JOIN {rows} r ON r.query_id = n.query_id
  WHERE r.filter_source IS NULL OR r.filter_source = source)""",
        sql.candidates(pool, f"{name}_found", lexical_name, dense_name),
        sql.rerank(k, name, "texts", f"{name}_all", f"{name}_found"),
    ]


def agent_rounds(pool: int, k: int) -> list[str]:
    """Both rounds for the rows of ``asked``; the index tables, ``doc_vectors`` and ``texts`` stand before."""
    return [
        UNDERSTOOD, "first_rows AS (SELECT query_id, rewritten_query AS query, filter_source FROM understood)",
        *agent_round("first_hits", "first_rows", pool, k),
        f"""checked AS (
  SELECT query_id, rewritten_query, filter_source, CASE
    WHEN coalesce(max(score) FILTER (rank <= 5), 0) < 0.1 THEN 'widen'
    WHEN count(*) FILTER (rank <= 5 AND score >= 0.5) >= 1 THEN 'end' ELSE 'decompose' END AS next
  FROM understood LEFT JOIN first_hits USING (query_id) WHERE complexity = 'complex' GROUP BY ALL)""",
        "wide_rows AS (SELECT query_id, rewritten_query AS query, filter_source FROM checked WHERE next = 'widen')",
        *agent_round("wide_hits", "wide_rows", 2 * pool, k),
        PARTS.format(words=sql.tokens("rewritten_query"), rows="(SELECT * FROM checked WHERE next = 'decompose')"),
        "part_rows AS (SELECT a.query_id, a.query, filter_source FROM asked_parts a JOIN checked c ON c.query_id = a.whole)",
        *agent_round("part_hits", "part_rows", pool, 2 * k),
        merged_parts(k, "part_hits", "split_hits"),
        """agent_hits AS (
  SELECT query_id, product_id, score, rank FROM first_hits
  WHERE query_id NOT IN (SELECT query_id FROM checked WHERE next <> 'end')
  UNION ALL SELECT query_id, product_id, score, rank FROM wide_hits
  UNION ALL SELECT query_id, product_id, score, rank FROM split_hits)""",
    ]


AGENT = [*sql.SHOP_PRODUCTS, sql.SHOP_FIELDS, NAMED, SHOP_DOCS, SHOP_TEXTS, sql.bm25(FIELD_BOOSTS, 1, "unused"),
         *agent_rounds(POOL, K)]


@query("agentic_batch", sql.with_ctes(*AGENT, "SELECT * FROM agent_hits"))
def agentic_batch(spark: SparkSession, sf: str) -> DataFrame:
    return hits(agent.agentic(shop_search(spark, sf), named_queries(spark, sf), K))


@query("model_encode", """
SELECT doc_id AS product_id, source, [CAST(len(text) AS DOUBLE), CAST(len(text) - len(replace(text, 'e', '')) AS DOUBLE)] AS v
FROM documents""")
def model_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a model in the Python workers, here one of two counts."""
    def load():
        return lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]

    encode = models.encoder(load, normalize=False)
    return inputs.documents(spark, sf).select("product_id", "source", encode(F.col("text")).alias("v"))


@query("model_score", sql.with_ctes(
    sql.DOCUMENTS, sql.TEXT_QUERIES, sql.bm25(TEXT_BOOST, K), TEXTS, """
scored AS (SELECT l.query_id, l.product_id, l.rank AS place,
    round(CAST(len(a.query) AS DOUBLE) / (len(a.query) + len(t.text)), 6) AS score
  FROM lexical l JOIN asked a USING (query_id) JOIN texts t USING (product_id))""", """
SELECT query_id, product_id, score, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM scored"""))
def model_score(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates in the order of a pair model in the Python workers, here one of lengths."""
    def load():
        return lambda queries, texts: [round(len(q) / (len(q) + len(t)), 6) for q, t in zip(queries, texts)]

    search, queries = text_search(spark, sf), inputs.text_queries(spark, sf)
    found = materialize(search.bm25(queries, K).withColumn("leg", F.lit(0)), "hits")
    return hits(rerank.pairwise(rerank.with_texts(found, queries, search.texts), models.pair_scorer(load), K))


@query("model_answers", f"""
SELECT conv_id, turn, query AS prompt, CASE WHEN len(query) % 7 <> 0 THEN reverse(query) END AS answer
FROM {ASKED_TURNS}""")
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a generating model, each distinct prompt asked once, in slices; some calls fail."""
    def load():
        def generate(prompts):
            if any(len(p) % 7 == 0 for p in prompts):
                raise RuntimeError("no answer")
            return [p[::-1] for p in prompts]
        return generate

    rows = user_turns(spark, sf).select("conv_id", "turn", F.col("query").alias("prompt"))
    return models.ask(rows, load, scratch_path(spark, "answers"), batch=1, slices=4)
