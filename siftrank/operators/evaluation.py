"""Recall, MRR and NDCG of ranked runs against graded judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.fixed_values import CUTOFFS
from siftrank.operators.ranking import full_rank, top_n
from siftrank.scratch import materialize


def checked_cutoffs(ks: list[int]) -> list[int]:
    """Sorted distinct cutoffs; an error for none or for one that is not a positive whole number."""
    if not ks:
        raise ValueError("at least one cutoff is needed")
    if any(not isinstance(k, int) or isinstance(k, bool) or k <= 0 for k in ks):
        raise ValueError("cutoffs must be positive whole numbers")
    return sorted(set(ks))


def normalized(qrels: DataFrame) -> DataFrame:
    """Ids as strings and gains as doubles."""
    return qrels.select(
        F.col("query_id").cast("string").alias("query_id"),
        F.col("product_id").cast("string").alias("product_id"),
        F.col("gain").cast("double").alias("gain"),
    )


def binarized(qrels: DataFrame, threshold: float) -> DataFrame:
    """Gain 1 from the threshold on, else 0; every query stays."""
    return qrels.withColumn("gain", F.when(F.col("gain") >= threshold, 1.0).otherwise(0.0))


def perfect_run(qrels: DataFrame) -> DataFrame:
    """All judged products of each query, best gain first, then by id."""
    return full_rank(
        qrels.select("query_id", "product_id", "gain"), ["query_id"], [F.desc("gain"), F.asc("product_id")]
    ).select("query_id", "product_id", "rank")


def run_from_scores(scored: DataFrame, depth: int) -> DataFrame:
    """Ranks from scores, down to ``depth``: higher score first, then by id."""
    return top_n(scored, ["query_id"], [F.desc("score"), F.asc("product_id")], depth)


def run_scores(run: DataFrame, mode: str = "reciprocal_rank") -> DataFrame:
    """A score for each position, by position alone."""
    if mode == "reciprocal_rank":
        return run.withColumn("score", 1 / F.col("rank"))
    if mode == "constant":
        return run.withColumn("score", F.lit(1.0))
    if mode == "linear":
        sizes = run.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
        return run.join(sizes, "query_id").withColumn(
            "score", (F.col("_n") - F.col("rank") + 1).cast("double")
        ).drop("_n")
    raise ValueError("mode must be 'reciprocal_rank', 'linear' or 'constant'")


def _value(gain: Column, how: str) -> Column:
    if how == "linear":
        return gain
    if how == "exp2":
        return F.pow(F.lit(2.0), gain) - 1
    raise ValueError("gain must be 'linear' or 'exp2'")


def _asked(qrels: DataFrame, ks: list[int], relevant: Column, discounted: Column) -> DataFrame:
    """Number of relevant products and ideal gains of each judged query."""
    rank = F.col("rank")
    ideal = top_n(qrels.filter("gain > 0"), ["query_id"], [F.desc("gain"), F.asc("product_id")], max(ks)).groupBy(
        "query_id"
    ).agg(*[F.sum(F.when(rank <= k, discounted)).alias(f"ideal{k}") for k in ks])
    counted = qrels.groupBy("query_id").agg(F.count_if(relevant).alias("relevant"))
    return counted.join(ideal, "query_id", "left")


def _best_ranks(run: DataFrame, keys: list[str], deepest: int) -> DataFrame:
    """Products down to the deepest cutoff; one that a run lists twice counts at its best rank.

    A product's best rank is within the cutoff if any is, so what lies below is left out before anything is grouped.
    """
    return run.filter(F.col("rank") <= deepest).groupBy("strategy", *keys, "product_id").agg(F.min("rank").alias("rank"))


def per_query(qrels: DataFrame, run: DataFrame, ks: list[int] | None = None, *, threshold: float | None = None,
              gain: str = "linear", ids: DataFrame | None = None) -> DataFrame:
    """Metrics of each strategy and query that was run and judged, one column per metric and cutoff.

    ``run`` has ``query_id, product_id, rank`` and may have ``strategy``.
    Recall and MRR count a product from gain 1 on, or from ``threshold``.
    With ``ids`` (see :func:`evaluate`) there are rows only for queries of
    which a list holds a judged product; all metrics of the others are 0.
    """
    ks = checked_cutoffs(ks or CUTOFFS)
    if "strategy" not in run.columns:
        run = run.withColumn("strategy", F.lit("run"))
    relevant = F.col("gain") >= F.lit(1.0 if threshold is None else threshold)
    discounted = _value(F.col("gain"), gain) / F.log2(F.col("rank") + 1)
    rank = F.col("rank")
    asked = _asked(qrels, ks, relevant, discounted)
    if ids is None:
        # Unjudged hits stay, so a query that was run counts as answered without a second pass.
        shallow = _best_ranks(run, ["query_id"], max(ks)).join(qrels, ["query_id", "product_id"], "left")
    else:
        shallow = _judged_hits(qrels, run, ids, max(ks))
    scored = shallow.groupBy("strategy", "query_id").agg(
        F.min(F.when(relevant, rank)).alias("first"),
        *[F.count_if(relevant & (rank <= k)).alias(f"hits{k}") for k in ks],
        *[F.sum(F.when(rank <= k, discounted)).alias(f"dcg{k}") for k in ks],
    )
    zero = F.lit(0.0)
    metrics = []
    for k in ks:
        metrics += [
            F.coalesce(F.try_divide(F.col(f"hits{k}"), F.col("relevant")), zero).alias(f"recall_{k}"),
            F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(zero).alias(f"mrr_{k}"),
            F.coalesce(F.try_divide(F.col(f"dcg{k}"), F.col(f"ideal{k}")), zero).alias(f"ndcg_{k}"),
        ]
    return scored.join(asked, "query_id").select("strategy", "query_id", *metrics)


def _judged_hits(qrels: DataFrame, lists: DataFrame, ids: DataFrame, deepest: int) -> DataFrame:
    """``strategy, query_id, product_id, gain, rank`` of the judged products in the lists that queries share.

    The judgements meet the lists as they are; no list is copied for each of its queries.
    """
    keys = [c for c in ids.columns if c != "query_id"]
    listed = _best_ranks(lists, keys, deepest)
    products = lists.filter(F.col("rank") <= deepest).select("product_id").distinct()
    pairs = qrels.join(products, "product_id", "left_semi").join(ids, "query_id")
    # As in a run of its own, a query's product counts once if several of its lists hold it.
    return pairs.join(listed, [*keys, "product_id"]).groupBy("strategy", "query_id", "product_id", "gain").agg(
        F.min("rank").alias("rank"))


def _answered(qrels: DataFrame, lists: DataFrame, ids: DataFrame, deepest: int) -> DataFrame:
    """``strategy, answered``: judged queries with a list of the strategy."""
    keys = [c for c in ids.columns if c != "query_id"]
    judged = ids.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    known = lists.filter(F.col("rank") <= deepest).select("strategy", *keys).distinct()
    pairs = judged.join(known, keys).select("strategy", "query_id").distinct()
    return pairs.groupBy("strategy").agg(F.count(F.lit(1)).alias("answered"))


def evaluate(qrels: DataFrame, run: DataFrame, ks: list[int] | None = None, *, threshold: float | None = None,
             gain: str = "linear", ids: DataFrame | None = None) -> DataFrame:
    """Mean of each metric: ``strategy, metric, k, score, score_answered, n_queries, n_missing``.

    ``score`` averages over all judged queries, those without a run counting 0;
    ``score_answered`` over the queries that were run.  Queries of the run that
    nobody judged are dropped; a strategy without a judged query has score 0.

    Queries that share their ranked lists need no copy of them each: ``ids`` has
    ``query_id`` and the columns that name a list, and ``run`` has these columns
    in place of ``query_id``.  The metrics are those of the copied lists.
    """
    ks = checked_cutoffs(ks or CUTOFFS)
    if "strategy" not in run.columns:
        run = run.withColumn("strategy", F.lit("run"))
    values = per_query(qrels, run, ks, threshold=threshold, gain=gain, ids=ids)
    names = [(m, k) for m in ("mrr", "ndcg", "recall") for k in ks]
    # Every strategy of the run has a row, also one without a judged query.
    present = values.unionByName(run.select("strategy").distinct(), allowMissingColumns=True)
    sums = present.groupBy("strategy").agg(
        F.count("query_id").alias("answered"), *[F.sum(f"{m}_{k}").alias(f"{m}_{k}") for m, k in names]
    )
    if ids is not None:
        answered = _answered(qrels, run, ids, max(ks))  # a row per strategy
        sums = sums.drop("answered").join(answered, "strategy", "left").withColumn("answered", F.coalesce("answered", F.lit(0)))
    total = qrels.agg(F.count_distinct("query_id")).scalar().alias("n_queries")
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"),
                 F.coalesce(f"{m}_{k}", F.lit(0.0)).alias("total")) for m, k in names
    ])).alias("row")
    return sums.select("strategy", "answered", total, rows).select(
        "strategy", "row.metric", "row.k",
        F.round(F.coalesce(F.try_divide(F.col("row.total"), F.col("n_queries")), F.lit(0.0)), 6).alias("score"),
        F.round(F.try_divide(F.col("row.total"), F.col("answered")), 6).alias("score_answered"),
        "n_queries", (F.col("n_queries") - F.col("answered")).alias("n_missing"),
    ).orderBy("strategy", "metric", "k")  # a row per strategy, metric and cutoff


def evaluate_classes(run: DataFrame, queries: DataFrame, products: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """Metrics where a product is relevant when its ``label`` is the query's: ``metric, k, score, n_queries``.

    A query's number of relevant products is the size of its class, so no pair
    of a query and a relevant product that was not found is ever built.  Queries
    without a run count 0; a class without products has no ideal and scores 0.
    """
    ks = checked_cutoffs(ks or CUTOFFS)
    rank = F.col("rank")
    sizes = products.groupBy("label").agg(F.count(F.lit(1)).alias("relevant"))
    asked = queries.select("query_id", "label").join(sizes, "label", "left").withColumn(
        "relevant", F.coalesce("relevant", F.lit(0)))
    # A product that a run lists twice counts at its best rank.
    best = run.groupBy("query_id", "product_id").agg(F.min("rank").alias("rank")).filter(rank <= max(ks))
    labels = products.select("product_id", F.col("label").alias("_found"))
    hits = best.join(labels, "product_id").join(queries.select("query_id", "label"), "query_id")
    good = hits.filter(F.col("_found") == F.col("label"))
    gain = 1 / F.log2(rank + 1)
    found = good.groupBy("query_id").agg(
        F.min("rank").alias("first"), *[F.count_if(rank <= k).alias(f"hits{k}") for k in ks],
        *[F.sum(F.when(rank <= k, gain)).alias(f"dcg{k}") for k in ks])

    def ideal(k: int) -> Column:
        places = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long")), lambda i: i <= F.col("relevant"))
        return F.aggregate(places, F.lit(0.0), lambda total, i: total + 1 / F.log2(i + 1))

    zero = F.lit(0.0)
    values = []
    for k in ks:
        values += [("mrr", k, F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(zero)),
                   ("ndcg", k, F.coalesce(F.try_divide(F.col(f"dcg{k}"), ideal(k)), zero)),
                   ("recall", k, F.coalesce(F.try_divide(F.col(f"hits{k}"), F.col("relevant")), zero))]
    means = asked.join(found, "query_id", "left").agg(
        F.count(F.lit(1)).alias("n_queries"), *[F.avg(v).alias(f"{m}_{k}") for m, k, v in values])
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.round(F.col(f"{m}_{k}"), 6).alias("score"))
        for m, k, _ in values
    ])).alias("row")
    return means.select("n_queries", rows).select("row.metric", "row.k", "row.score", "n_queries").orderBy("metric", "k")


def compare(metrics: DataFrame, baseline: str | None = None, ks: list[int] | None = None) -> DataFrame:
    """Strategies by NDCG at the first cutoff, with their lift over ``baseline``.

    The table has one row per strategy, so the ranking window is small.
    """
    ks = checked_cutoffs(ks or CUTOFFS)
    small = metrics.filter("metric = 'ndcg'")
    table = small.groupBy("strategy").agg(*[
        F.round(F.max(F.when(F.col("k") == k, F.col("score"))), 4).alias(f"ndcg_{k}") for k in ks
    ])
    first = F.col(f"ndcg_{ks[0]}")
    everything = Window.orderBy(first.desc(), F.asc("strategy"))
    ranked = table.withColumn("place", F.row_number().over(everything).cast("long"))
    if baseline is None:
        return ranked
    base = F.max(F.when(F.col("strategy") == baseline, first)).over(
        Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return ranked.withColumn("lift", F.round(F.try_divide(first - base, base), 4))


def perfect_check(qrels: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """Metrics of the perfect run: NDCG is 1 wherever a judged product has a gain."""
    return evaluate(qrels, materialize(perfect_run(qrels), "perfect"), ks)
