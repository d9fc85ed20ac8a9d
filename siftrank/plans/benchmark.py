"""All strategies over one query table, judged in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank import fixed_values as fixed
from siftrank.operators import evaluation, fusion, rerank
from siftrank.operators.merging import subset
from siftrank.operators.sampling import first_queries
from siftrank.plans.agent import agentic
from siftrank.plans.strategies import Search, distinct_texts
from siftrank.scratch import materialize
from siftrank.sources.exchange import write_ranked_json
from siftrank.sources.tables import write_csv

STRATEGIES = ["bm25", "knn", "hybrid_rrf", "hybrid_rerank", "hybrid_listwise",
              "hyde_rerank", "hyde_listwise", "agentic"]
DEFAULT = ["bm25", "knn", "hybrid_rrf", "hybrid_rerank", "agentic"]
GENERATIVE = STRATEGIES[4:]


def ranked_lists(search: Search, queries: DataFrame, depth: int = 100, pool: int = 20,
                 listwise_pool: int = fixed.POOL_FUSION, rrf_k: int = fixed.RRF_K, strategies: list[str] | None = None,
                 limit_generative: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked lists of the chosen strategies, one per distinct text, and the queries that they answer.

    The lists are ``strategy, list_id, limited, product_id, rank``; the queries
    ``query_id, list_id, limited``, where a list is ``limited`` if its strategy
    was not run for all queries.

    Queries are encoded once, and both retrievals run once to the deepest pool
    any strategy asks for; every strategy takes its part of them.  Strategies
    that generate text can be limited to the first queries by id.
    """
    chosen = strategies or DEFAULT
    unknown = set(chosen) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    texts, ids = distinct_texts(queries)
    few_texts, few_ids = texts, ids
    if limit_generative is not None:
        few_ids = subset(ids, first_queries(queries.select("query_id"), limit_generative))
        few_texts = subset(texts, few_ids.select(F.col("_as").alias("query_id")))
    if "filter_source" not in queries.columns:
        texts, few_texts = texts.drop("filter_source"), few_texts.drop("filter_source")
    encoded = search.encoded(texts)
    deepest = max(depth, pool, listwise_pool)
    legs = search.kept_legs(texts, encoded, deepest)
    title_legs = None
    if {"hyde_rerank", "hyde_listwise"} & set(chosen):
        wanted = subset(encoded, few_texts)
        title_legs = (legs[0], materialize(search.knn(search.titled(wanted), deepest), "dense"))

    def cut(size: int) -> list[DataFrame]:
        return [leg.filter(F.col("rank") <= size) for leg in legs]

    def pairs(asked: DataFrame, of: tuple[DataFrame, DataFrame]) -> DataFrame:
        return rerank.pairwise(search.found(asked, of, pool), search.models.score, depth)

    def lists(of: tuple[DataFrame, DataFrame]) -> DataFrame:
        listed = rerank.listwise_prompts(search.found(few_texts, of, listwise_pool))
        return rerank.listwise(search.models.rank(listed), depth)

    plans = {
        "bm25": lambda: cut(depth)[0],
        "knn": lambda: cut(depth)[1],
        "hybrid_rrf": lambda: fusion.rrf(cut(pool), depth, rrf_k),
        "hybrid_rerank": lambda: pairs(texts, legs),
        "hybrid_listwise": lambda: lists(legs),
        "hyde_rerank": lambda: pairs(few_texts, title_legs),
        "hyde_listwise": lambda: lists(title_legs),
        "agentic": lambda: agentic(search, few_texts, depth),
    }
    ranked = []
    for name in chosen:
        limited = F.lit(limit_generative is not None and name in GENERATIVE).alias("limited")
        ranked.append(plans[name]().select(
            F.lit(name).alias("strategy"), F.col("query_id").alias("list_id"), limited, "product_id", "rank"))

    def answering(some: DataFrame, limited: bool) -> DataFrame:
        return some.select("query_id", F.col("_as").alias("list_id"), F.lit(limited).alias("limited")).distinct()

    asked = answering(ids, False)
    if limit_generative is not None:
        asked = asked.unionByName(answering(few_ids, True))
    return reduce(DataFrame.unionByName, ranked), asked


def for_queries(lists: DataFrame, ids: DataFrame) -> DataFrame:
    """The shared lists copied for each of their queries: ``strategy, query_id, product_id, rank``."""
    return ids.join(lists, ["list_id", "limited"]).select("strategy", "query_id", "product_id", "rank")


def run_strategies(search: Search, queries: DataFrame, *options: object, **named: object) -> DataFrame:
    """Ranked lists of every query, ``strategy, query_id, product_id, rank``; options as in :func:`ranked_lists`."""
    return for_queries(*ranked_lists(search, queries, *options, **named))


def write_outputs(runs: DataFrame, metrics: DataFrame, folder: str) -> None:
    """For every strategy its ranked lists as JSON and its metrics as CSV, below ``folder``."""
    for row in metrics.select("strategy").distinct().toLocalIterator():  # a handful of names
        own = F.col("strategy") == row.strategy
        write_ranked_json(runs.filter(own), f"{folder}/{row.strategy}_ranked")
        write_csv(metrics.filter(own).select("metric", "k", "score").orderBy("metric", "k").coalesce(1),
                  f"{folder}/{row.strategy}_metrics")


def benchmark(search: Search, queries: DataFrame, qrels: DataFrame, ks: list[int] | None = None, *,
              threshold: float | None = None, gain: str = "linear", folder: str | None = None,
              **run_options: object) -> DataFrame:
    """Metrics of all chosen strategies; the ranked lists are written once and measured together.

    Queries with the same text have the same lists: these are written for the
    text, and judged for each of its queries without a copy.  With a ``folder``
    each strategy's lists and metrics are also kept there, the lists by query.
    """
    lists, ids = ranked_lists(search, queries, **run_options)
    lists, ids = materialize(lists, "runs"), materialize(ids, "asked")
    metrics = evaluation.evaluate(qrels, lists, ks, threshold=threshold, gain=gain, ids=ids)
    if folder is not None:
        metrics = materialize(metrics, "metrics")
        write_outputs(for_queries(lists, ids), metrics, folder)
    return metrics
