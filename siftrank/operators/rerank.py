"""Second-stage order of each query's candidates by a model the caller supplies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.fixed_values import PASSAGE_CHARS
from siftrank.functions.prompts import permutation, ranking_prompt, shown
from siftrank.operators.ranking import top_n
from siftrank.scratch import fan_out

PairScorer = Callable[[Column, Column], Column]


def with_texts(found: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates with the query and the product's text (``texts``: product_id, text).

    Only the texts that some candidate needs are moved: a written candidate
    table is broadcast to the texts by Spark's threshold, and beyond it the
    join on the product filters them first.  A candidate without a text stays
    and has an empty one.
    """
    wanted = texts.join(found.select("product_id").distinct(), "product_id", "left_semi")
    asked = fan_out(found, "query_id", "product_id").join(queries.select("query_id", "query"), "query_id")
    return asked.join(wanted, "product_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def pairwise(found: DataFrame, scorer: PairScorer, k: int) -> DataFrame:
    """Order by the scorer's value; equal values keep the candidates' order.  The score shown is rounded."""
    scored = found.withColumn("score", scorer(F.col("query"), F.col("text")))
    return top_n(
        scored.select("query_id", "product_id", "source", "score", "leg", F.col("rank").alias("_rank")),
        ["query_id"], [F.desc("score"), F.asc("leg"), F.asc("_rank")], k,
    ).withColumn("score", F.round("score", 6)).drop("leg", "_rank")


def listwise_prompts(found: DataFrame, chars: int | None = PASSAGE_CHARS) -> DataFrame:
    """One row per query: its ordered candidates and the prompt that asks for their order.

    A query has at most two pools of candidates, so its list is bounded; of each
    text only the ``chars`` that the prompt shows are gathered (None: all).
    """
    listed = found.withColumn("text", shown(F.col("text"), chars)).groupBy("query_id").agg(
        F.first("query").alias("query"),
        F.sort_array(F.collect_list(F.struct("leg", "rank", "product_id", "source", "score", "text"))).alias("hits"),
    )
    return listed.withColumn(
        "prompt", ranking_prompt(F.col("query"), F.transform("hits", lambda hit: hit["text"]), None)
    )


def listwise(answered: DataFrame, k: int) -> DataFrame:
    """Candidates in the order of the ``answer``; a missing answer keeps their order.

    Hits keep the score of their retrieval.
    """
    ordered = answered.select(
        "query_id", "hits",
        F.posexplode(F.slice(permutation(F.col("answer"), F.size("hits")), 1, k)).alias("at", "which"),
    )
    hit = F.get(F.col("hits"), F.col("which") - 1)
    return ordered.select("query_id", hit.alias("hit"), (F.col("at") + 1).cast("long").alias("rank")).select(
        "query_id", "hit.product_id", "hit.source", "hit.score", "rank"
    )


def best_of_subqueries(hits: DataFrame, k: int) -> DataFrame:
    """Best score per product over a query's sub-queries, the earlier hit on equal scores."""
    best = top_n(
        hits, ["query_id", "product_id"], [F.desc("score"), F.asc("part"), F.asc("rank")], 1, rank="_first"
    ).withColumnRenamed("rank", "_rank")
    return top_n(
        best, ["query_id"], [F.desc("score"), F.asc("part"), F.asc("_rank")], k
    ).drop("_first", "_rank", "part")
