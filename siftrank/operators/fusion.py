"""Union of ranked lists and reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.fixed_values import RRF_K
from siftrank.operators.ranking import top_n


def rrf(runs: list[DataFrame], k: int, rrf_k: int = RRF_K, with_source: bool = False) -> DataFrame:
    """Sum of ``1 / (rrf_k + rank)`` over the runs; ties by id.  Hits without an id are skipped.

    ``with_source`` keeps the ``source`` that the runs carry.
    """
    source = ["source"] if with_source else []
    hits = reduce(DataFrame.unionByName, [r.select("query_id", "product_id", "rank", *source) for r in runs])
    fused = (
        hits.filter("product_id is not null and cast(product_id as string) <> ''")
        .groupBy("query_id", "product_id")
        .agg(F.round(F.sum(1 / (rrf_k + F.col("rank"))), 9).alias("score"), *[F.max(c).alias(c) for c in source])
    )
    return top_n(fused, ["query_id"], [F.desc("score"), F.asc("product_id")], k)


def candidates(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Both runs' hits once each, the lexical ones first: ``position`` is the order.

    ``score`` and ``source`` are those of the dense hit where both have one.
    Each run holds at most its pool per query, so a query has a bounded number
    of candidates.
    """
    first = lexical.select("query_id", "product_id", F.lit(0).alias("leg"), "rank", "score", "source")
    second = dense.select("query_id", "product_id", F.lit(1).alias("leg"), "rank", "score", "source")
    merged = (
        first.unionByName(second)
        .filter("product_id is not null and cast(product_id as string) <> ''")
        .groupBy("query_id", "product_id")
        .agg(
            F.min(F.struct("leg", "rank")).alias("place"),
            F.max_by(F.struct("score", "source"), "leg").alias("hit"),
        )
    )
    return merged.select("query_id", "product_id", "hit.score", "hit.source", "place.leg", "place.rank")
