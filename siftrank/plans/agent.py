"""Search in at most two rounds: understand, retrieve, check, then widen or decompose.

The rounds are fixed, so the whole query table passes through each step as one
table; a step works on the queries still open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank import fixed_values as fixed
from siftrank.functions.prompts import hits_summary
from siftrank.functions.text import clean_query, strip, tokens
from siftrank.operators.rerank import best_of_subqueries
from siftrank.plans.strategies import Search
from siftrank.scratch import materialize

Step = Callable[[DataFrame], DataFrame]


def resolved_source(caller: Column, model: Column) -> Column:
    """The caller's source first, then a known one from the model, else none."""
    named = F.upper(strip(model))
    return F.coalesce(F.nullif(caller, F.lit("")), F.when(named.isin("ESCI", "WANDS"), named))


def understood(state: DataFrame) -> DataFrame:
    """Fields of a model's JSON ``answer`` as columns; the query itself for a blank rewrite."""
    fields = F.from_json("answer", "rewritten_query string, filter_source string, complexity string")
    rows = state.withColumn("_said", fields)
    rewritten = strip(F.col("_said.rewritten_query"))
    caller = F.col("filter_source") if "filter_source" in state.columns else F.lit(None).cast("string")
    return rows.select(
        "query_id", "query",
        F.when(rewritten != "", rewritten).otherwise(F.col("query")).alias("rewritten_query"),
        resolved_source(caller, F.col("_said.filter_source")).alias("filter_source"),
        F.when(F.col("_said.complexity") == "complex", "complex").otherwise("simple").alias("complexity"),
    )


def stand_in_understanding(queries: DataFrame) -> DataFrame:
    """Deterministic stand-in: opening phrases dropped, a named shop as source, long queries complex."""
    text = F.lower("query")
    said = F.struct(
        clean_query(F.col("query")).alias("rewritten_query"),
        F.when(text.rlike(r"\b(amazon|esci)\b"), "ESCI").when(text.rlike(r"\b(wayfair|wands)\b"), "WANDS")
        .otherwise("").alias("filter_source"),
        F.when(F.size(F.array_distinct(tokens(F.col("query")))) >= 4, "complex").otherwise("simple").alias("complexity"),
    )
    return understood(queries.withColumn("answer", F.to_json(said)))


def action_for(quality: Column, iteration: Column) -> Column:
    """Written rules from quality to action."""
    return (
        F.when(iteration >= fixed.MAX_ROUNDS, "return")
        .when(quality == "low_coverage", "widen")
        .when(quality == "multi_constraint_miss", "decompose")
        .otherwise("return")
    )


def stand_in_quality(scores: Column) -> Column:
    """Deterministic stand-in from the shown scores, best first."""
    shown = F.slice(scores, 1, fixed.SUMMARY_HITS)
    return (
        F.when(~F.exists(shown, lambda s: s >= fixed.WEAK_SCORE), "low_coverage")
        .when(F.size(F.filter(shown, lambda s: s >= fixed.GOOD_SCORE)) >= fixed.GOOD_HITS, "good")
        .when(F.exists(shown, lambda s: s >= fixed.GOOD_SCORE), "semantic_drift")
        .otherwise("multi_constraint_miss")
    )


def stand_in_assessment(state: DataFrame) -> DataFrame:
    quality = stand_in_quality(F.transform("hits", lambda hit: hit["score"]))
    return state.withColumn("quality", quality).withColumn("action", action_for(F.col("quality"), F.col("iteration")))


def route(complexity: Column, iteration: Column, action: Column) -> Column:
    """Next step after retrieval and check."""
    return (
        F.when(complexity == "simple", "end")
        .when((iteration >= fixed.MAX_ROUNDS) | (action == "return"), "end")
        .when(action == "widen", "widen")
        .when(action == "decompose", "decompose")
        .otherwise("end")
    )


def stand_in_parts(state: DataFrame) -> DataFrame:
    """Deterministic stand-in: first and second half of the query's words."""
    words = tokens(F.col("rewritten_query"))
    half = F.ceil(F.size("_words") / 2).cast("int")
    halves = F.array(
        F.array_join(F.slice("_words", F.lit(1), half), " "),
        F.array_join(F.slice("_words", half + 1, F.size("_words")), " "),
    )
    return state.withColumn("_words", words).select(
        "query_id", "filter_source", F.posexplode(halves).alias("part", "query")
    ).filter("query <> ''")


def with_hits(state: DataFrame, hits: DataFrame, texts: DataFrame, n: int = fixed.SUMMARY_HITS,
              chars: int | None = fixed.SUMMARY_CHARS) -> DataFrame:
    """Each query's shown hits as an array and as the summary a model reads.

    ``texts`` holds product_id with ``full_text`` (else ``text``) and may have
    ``product_class``.  A hit without a text stays.  Only the ``n`` shown hits
    are gathered, so a query's array is bounded.
    """
    body = F.col("full_text" if "full_text" in texts.columns else "text")
    product_class = F.col("product_class") if "product_class" in texts.columns else F.lit(None).cast("string")
    told = texts.select("product_id", product_class.alias("product_class"), body.alias("text"))
    shown = hits.filter(F.col("rank") <= n).join(told, "product_id", "left")
    gathered = shown.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score", "product_class", "text"))).alias("hits")
    )
    joined = state.join(gathered, "query_id", "left")
    none = F.filter(F.array(F.struct(
        F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("score"),
        F.lit("").alias("product_class"), F.lit("").alias("text"),
    )), lambda _: F.lit(False))
    filled = joined.withColumn("hits", F.coalesce("hits", none))
    return filled.withColumn("hits_summary", hits_summary(F.col("hits"), n, chars))


def agentic(search: Search, queries: DataFrame, k: int, pool: int = fixed.POOL_RERANK, *,
            understand: Step = stand_in_understanding, assess: Step = stand_in_assessment,
            decompose: Step = stand_in_parts, with_query: bool = False) -> DataFrame:
    """Top ``k`` per query after at most two rounds; the steps may call a model.

    ``with_query`` adds the ``rewritten_query`` that was searched.

    The second round retrieves once for all reopened queries: widened ones with
    twice the pool, and the parts of decomposed ones with twice the depth.
    """
    columns = ["query_id", "product_id", "source", "score", "rank"]
    state = materialize(understand(queries), "state")
    asked = state.select("query_id", F.col("rewritten_query").alias("query"), "filter_source")
    first = materialize(search.hybrid_rerank(asked, k, pool).select(*columns), "round")

    open_queries = state.filter("complexity = 'complex'").withColumn("iteration", F.lit(1))
    checked = assess(with_hits(open_queries, first, search.shown()))
    routed = materialize(checked.select(
        "query_id", "rewritten_query", "filter_source",
        route(F.col("complexity"), F.col("iteration"), F.col("action")).alias("next"),
    ), "routed")

    again = ["whole", "part", "query", "filter_source", "pool", "depth"]
    wide = routed.filter("next = 'widen'").select(
        F.col("query_id").alias("whole"), F.lit(0).alias("part"), F.col("rewritten_query").alias("query"),
        "filter_source", F.lit(2 * pool).alias("pool"), F.lit(k).alias("depth"),
    )
    parts = decompose(routed.filter("next = 'decompose'")).select(
        F.col("query_id").alias("whole"), "part", "query", "filter_source", F.lit(pool).alias("pool"), F.lit(2 * k).alias("depth"),
    )
    # The searched texts get numbers of their own, whatever the type of the queries' ids.
    numbered = wide.select(*again).unionByName(parts.select(*again)).withColumn("query_id", F.monotonically_increasing_id())
    reopened = materialize(numbered, "reopened")
    second = search.hybrid_rerank(reopened.drop("whole", "part", "depth"), 2 * k, 2 * pool)
    of_query = second.join(reopened.select("query_id", "whole", "part", "depth"), "query_id").filter("rank <= depth")
    merged = best_of_subqueries(of_query.drop("query_id", "depth").withColumnRenamed("whole", "query_id"), k)
    finished = routed.filter("next <> 'end'").select("query_id")
    found = first.join(finished, "query_id", "left_anti").unionByName(merged.select(*columns))
    return found.join(state.select("query_id", "rewritten_query"), "query_id") if with_query else found
