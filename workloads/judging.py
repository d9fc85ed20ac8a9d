"""Evaluation of runs and comparison of strategies over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.fixed_values import CUTOFFS, ESCI_GAINS, FIELD_BOOSTS, POOL_RERANK
from siftrank.operators import dense, evaluation
from siftrank.operators.curation import build_qrels
from siftrank.operators.merging import subset
from siftrank.plans import benchmark
from siftrank.scratch import materialize
from workloads import inputs, retrieval, sql
from workloads.registry import query

JUDGED = [sql.EXAMPLES, sql.SHOP_QRELS, sql.SHOP_RUN, """
run AS (SELECT 'run' AS strategy, * FROM shop_run
        WHERE query_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0))"""]


def judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Judgements, and a run that leaves the customers in debt unanswered."""
    qrels = materialize(inputs.shop_qrels(spark, sf), "qrels")
    solvent = inputs.table(spark, sf, "customer").filter("c_acctbal > 0")
    run = subset(inputs.shop_run(qrels), solvent.select(inputs.text("c_custkey").alias("query_id")))
    return evaluation.normalized(qrels), run


def metric_sql(metric: str, gain: str = "linear", threshold: float = 1.0) -> str:
    return sql.with_ctes(
        *JUDGED, *sql.metrics("shop_qrels", "run", CUTOFFS, threshold, gain, f"metric = '{metric}'")
    )


def metric(spark: SparkSession, sf: str, name: str, **options: object) -> DataFrame:
    return evaluation.evaluate(*judged(spark, sf), **options).filter(F.col("metric") == name)


@query("eval_recall", metric_sql("recall"))
def eval_recall(spark: SparkSession, sf: str) -> DataFrame:
    return metric(spark, sf, "recall")


@query("eval_mrr", metric_sql("mrr"))
def eval_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return metric(spark, sf, "mrr")


@query("eval_ndcg", metric_sql("ndcg"))
def eval_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return metric(spark, sf, "ndcg")


@query("eval_ndcg_exp2", metric_sql("ndcg", "exp2"))
def eval_ndcg_exp2(spark: SparkSession, sf: str) -> DataFrame:
    return metric(spark, sf, "ndcg", gain="exp2")


@query("eval_binary", sql.with_ctes(*JUDGED, *sql.metrics("shop_qrels", "run", CUTOFFS, 2.0)))
def eval_binary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.evaluate(*judged(spark, sf), threshold=2.0)


BLIND = """both_runs AS (
  SELECT * FROM run UNION ALL SELECT 'blind', query_id || ' of nobody', product_id, rank FROM run)"""
EMPTY_ROWS = """
SELECT * FROM scored UNION ALL
SELECT 'blind', metric, k, 0e0, NULL, n_queries, n_queries FROM scored"""


@query("eval_empty_strategy", sql.with_ctes(
    *JUDGED, BLIND, *(lambda m: [*m[:-1], f"scored AS ({m[-1]})"])(sql.metrics("shop_qrels", "both_runs", CUTOFFS)), EMPTY_ROWS))
def eval_empty_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """A strategy none of whose queries was judged has score 0, and all queries missing."""
    qrels, run = judged(spark, sf)
    blind = run.select(F.concat("query_id", F.lit(" of nobody")).alias("query_id"), "product_id", "rank")
    both = run.withColumn("strategy", F.lit("run")).unionByName(blind.withColumn("strategy", F.lit("blind")))
    return evaluation.evaluate(qrels, both)


@query("eval_repeated_hits", sql.with_ctes(*JUDGED, """
later AS (SELECT strategy, query_id, product_id, 2 * rank - 1 AS rank FROM run)""",
    *sql.metrics("shop_qrels", "later", CUTOFFS)))
def eval_repeated_hits(spark: SparkSession, sf: str) -> DataFrame:
    """A product that a run lists twice counts once, at its better rank."""
    qrels, run = judged(spark, sf)
    return evaluation.evaluate(qrels, run.select(
        "query_id", "product_id", F.explode(F.array(2 * F.col("rank") - 1, 2 * F.col("rank"))).alias("rank")))


@query("binarize_qrels", sql.with_ctes(
    sql.EXAMPLES, sql.SHOP_QRELS,
    "SELECT query_id, product_id, CASE WHEN gain >= 2 THEN 1e0 ELSE 0e0 END AS gain FROM shop_qrels"))
def binarize_qrels(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.binarized(inputs.shop_qrels(spark, sf), 2.0)


UNCAPPED = sql.qrels("all_qrels", "examples", "esci", "esci_label", "", cap=None)


def uncapped(spark: SparkSession, sf: str) -> DataFrame:
    return build_qrels(inputs.shop_judged(spark, sf), label="esci_label", gains=ESCI_GAINS, prefix="", cap=None)


@query("perfect_run", sql.with_ctes(sql.EXAMPLES, UNCAPPED, """
SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, product_id) AS rank
FROM all_qrels"""))
def perfect_run(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.perfect_run(uncapped(spark, sf))


@query("eval_perfect", sql.with_ctes(sql.EXAMPLES, UNCAPPED, """
run AS (SELECT 'run' AS strategy, query_id, product_id,
               row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, product_id) AS rank FROM all_qrels)""",
    *sql.metrics("all_qrels", "run", CUTOFFS)))
def eval_perfect(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.perfect_check(materialize(uncapped(spark, sf), "qrels"))


@query("run_scores", sql.with_ctes(sql.EXAMPLES, sql.SHOP_QRELS, sql.SHOP_RUN, """
SELECT 'reciprocal_rank' AS mode, *, round(1e0 / rank, 6) AS score FROM shop_run
UNION ALL SELECT 'linear', *, CAST(count(*) OVER (PARTITION BY query_id) - rank + 1 AS DOUBLE) FROM shop_run
UNION ALL SELECT 'constant', *, 1e0 FROM shop_run"""))
def run_scores(spark: SparkSession, sf: str) -> DataFrame:
    run = materialize(inputs.shop_run(inputs.shop_qrels(spark, sf)), "run")
    columns = ["mode", "query_id", "product_id", "rank", "score"]
    return reduce(DataFrame.unionByName, [
        evaluation.run_scores(run, mode).withColumn("mode", F.lit(mode))
        .withColumn("score", F.round("score", 6)).select(*columns)
        for mode in ("reciprocal_rank", "linear", "constant")
    ])


@query("run_from_scores", sql.with_ctes(sql.EXAMPLES, """
scored AS (SELECT query_id, product_id, max(length(query)) + count(*) AS score FROM examples GROUP BY ALL)""", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM scored)
WHERE rank <= 20"""))
def run_from_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = inputs.shop_judged(spark, sf).groupBy("query_id", "product_id").agg(
        (F.max(F.length("query")) + F.count(F.lit(1))).alias("score")
    )
    return evaluation.run_from_scores(scored, 20)


@query("eval_vectors", sql.with_ctes(
    retrieval.VECTORS, retrieval.VECTOR_QUERIES, sql.knn(20, "vectors", "wanted"), """
sizes AS (SELECT label, count(*) AS relevant FROM embeddings GROUP BY label)""", """
hits_at AS (SELECT query_id, d.rank FROM dense d JOIN embeddings q ON q.vec_id = d.query_id
            JOIN embeddings p ON p.vec_id = d.product_id AND p.label = q.label)""", """
cuts AS (SELECT unnest([5, 10, 20]) AS k)""", """
by_query AS (
  SELECT vec_id, k, any_value(relevant) AS relevant, min(rank) AS first, count(rank) AS hits, coalesce(sum(1e0 / log2(rank + 1)), 0) AS dcg
  FROM embeddings JOIN sizes USING (label) CROSS JOIN cuts LEFT JOIN hits_at ON query_id = vec_id AND rank <= k GROUP BY vec_id, k)""", """
valued AS (SELECT k, coalesce(1e0 / first, 0) AS mrr, hits / relevant AS recall,
                  dcg / list_sum(list_transform(range(1, least(k, relevant) + 1), lambda i: 1e0 / log2(i + 1))) AS ndcg FROM by_query)""", """
SELECT metric, CAST(k AS INTEGER) AS k, round(avg(value), 6) AS score, count(*) AS n_queries
FROM (UNPIVOT valued ON mrr, recall, ndcg INTO NAME metric VALUE value) GROUP BY metric, k"""))
def eval_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest neighbours judged by their label, all products of the query's label being relevant."""
    rows = inputs.table(spark, sf, "embeddings")
    run = dense.knn(inputs.vectors(spark, sf), inputs.vector_queries(spark, sf), 20)
    return evaluation.evaluate_classes(
        run, rows.select(F.col("vec_id").alias("query_id"), "label"), rows.select(F.col("vec_id").alias("product_id"), "label"))


OWN_CUTOFFS = [7, 1, 3, 3]


@query("eval_config", sql.with_ctes(*JUDGED, *sql.metrics("shop_qrels", "run", [1, 3, 7], 3.0, "exp2")))
def eval_config(spark: SparkSession, sf: str) -> DataFrame:
    """Cutoffs, threshold and gain of the caller; cutoffs are sorted and counted once."""
    return evaluation.evaluate(*judged(spark, sf), OWN_CUTOFFS, threshold=3.0, gain="exp2")


CUSTOMERS = """customers AS (SELECT query_id, query FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY row_no, product_id) AS r FROM examples) WHERE r = 1)"""
DEPTH = 100


def strategies_sql() -> list[str]:
    """All strategies for the customers' queries, retrieved once per distinct text."""
    return [
        *sql.SHOP_PRODUCTS, sql.SHOP_FIELDS, sql.EXAMPLES, CUSTOMERS, sql.SHOP_QRELS,
        "asked AS (SELECT min(query_id) AS query_id, query FROM customers GROUP BY query)",
        sql.bm25(FIELD_BOOSTS, DEPTH), retrieval.SHOP_DOCS, retrieval.ASKED_VECTORS,
        sql.knn(DEPTH, "doc_vectors", "asked_vectors"),
        *retrieval.TITLE_VECTORS, sql.knn(DEPTH, "doc_vectors", "mixed", "title_dense"),
        retrieval.SHOP_TEXTS,
        sql.rrf(DEPTH, "fused", """SELECT query_id, product_id, rank FROM lexical WHERE rank <= 20
                UNION ALL SELECT query_id, product_id, rank FROM dense WHERE rank <= 20"""),
        sql.candidates(20), sql.rerank(DEPTH, "reranked", "texts"),
        sql.candidates(50, "found50"), sql.listwise(DEPTH, "listed", "texts", found="found50"),
        sql.candidates(20, "title_found", dense="title_dense"),
        sql.rerank(DEPTH, "title_reranked", "texts", found="title_found"),
        sql.candidates(50, "title_found50", dense="title_dense"),
        sql.listwise(DEPTH, "title_listed", "texts", found="title_found50"),
        *retrieval.agent_rounds(POOL_RERANK, DEPTH),
        f"""short_runs AS (
  SELECT 'bm25' AS strategy, query_id, product_id, rank FROM lexical WHERE rank <= {DEPTH}
  UNION ALL SELECT 'knn', query_id, product_id, rank FROM dense WHERE rank <= {DEPTH}
  UNION ALL SELECT 'hybrid_rrf', query_id, product_id, rank FROM fused
  UNION ALL SELECT 'hybrid_rerank', query_id, product_id, rank FROM reranked
  UNION ALL SELECT 'hybrid_listwise', query_id, product_id, rank FROM listed
  UNION ALL SELECT 'hyde_rerank', query_id, product_id, rank FROM title_reranked
  UNION ALL SELECT 'hyde_listwise', query_id, product_id, rank FROM title_listed
  UNION ALL SELECT 'agentic', query_id, product_id, rank FROM agent_hits)""",
        """run AS (SELECT strategy, c.query_id, s.product_id, s.rank FROM short_runs s
  JOIN asked a USING (query_id) JOIN customers c ON c.query = a.query)""",
    ]


def shop_judgements(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements with the ids of the searchable parts."""
    return inputs.shop_qrels(spark, sf).withColumn("product_id", F.concat(F.lit("amz_"), "product_id"))


PREFIXED = "judged_parts AS (SELECT query_id, 'amz_' || product_id AS product_id, gain FROM shop_qrels)"


@query("benchmark_all", sql.with_ctes(*strategies_sql(), PREFIXED, *sql.metrics("judged_parts", "run", CUTOFFS)))
def benchmark_all(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark.benchmark(
        retrieval.shop_search(spark, sf), retrieval.customer_queries(spark, sf),
        materialize(shop_judgements(spark, sf), "qrels"), depth=DEPTH, strategies=benchmark.STRATEGIES,
    )


*METRIC_TABLES, METRICS = sql.metrics("judged_parts", "run", CUTOFFS)


@query("compare_runs", sql.with_ctes(*strategies_sql(), PREFIXED, *METRIC_TABLES, f"scores AS ({METRICS})", """
wide AS (
  SELECT strategy, round(max(score) FILTER (k = 5), 4) AS ndcg_5, round(max(score) FILTER (k = 10), 4) AS ndcg_10,
         round(max(score) FILTER (k = 20), 4) AS ndcg_20 FROM scores WHERE metric = 'ndcg' GROUP BY strategy)""", """
SELECT *, row_number() OVER (ORDER BY ndcg_5 DESC, strategy) AS place,
       round((ndcg_5 - (SELECT ndcg_5 FROM wide WHERE strategy = 'bm25'))
             / nullif((SELECT ndcg_5 FROM wide WHERE strategy = 'bm25'), 0), 4) AS lift FROM wide"""))
def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.compare(benchmark_all(spark, sf), baseline="bm25")
