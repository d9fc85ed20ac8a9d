"""Query and best product as training pairs, with the reasons for queries left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.functions.text import clean
from siftrank.operators.merging import subset
from siftrank.operators.ranking import first_of
from siftrank.sources.tables import write_counted

SKIP_REASONS = ["no_query", "no_positive", "missing_product", "empty_text"]


def positive_products(qrels: DataFrame) -> DataFrame:
    """Best product of each query: highest gain, then smallest id."""
    return first_of(qrels, ["query_id"], [F.desc("gain"), F.asc("product_id")])


def training_text(products: DataFrame) -> DataFrame:
    """Title, brand, name and class of a product, without the missing ones."""
    raw = F.col("metadata")
    names = ["product_title", "product_brand", "product_name", "product_class"]
    parts = [clean(F.try_element_at(raw, F.lit(n))) for n in names]
    return products.select("product_id", F.concat_ws(" ", *parts).alias("positive"))


def training_candidates(qrels: DataFrame, queries: DataFrame, products: DataFrame) -> DataFrame:
    """One row per judged query with its pair or the reason why there is none."""
    query_ids = qrels.select("query_id").distinct()
    best = positive_products(qrels.filter("gain is not null"))
    # Only the texts of positive products are moved.
    texts = training_text(subset(products, best, "product_id")).withColumn("_known", F.lit(True))
    reason = (
        F.when(F.coalesce(F.col("anchor"), F.lit("")) == "", "no_query")
        .when(F.col("product_id").isNull(), "no_positive")
        .when(F.col("_known").isNull(), "missing_product")
        .when(F.col("positive") == "", "empty_text")
    )
    return (
        query_ids.join(queries.select("query_id", F.col("query").alias("anchor")), "query_id", "left")
        .join(best.select("query_id", "product_id"), "query_id", "left")
        .join(texts, "product_id", "left")
        .select("query_id", "product_id", "anchor", "positive", reason.alias("skip_reason"))
    )


def training_pairs(candidates: DataFrame, max_pairs: int = 0) -> DataFrame:
    """Usable pairs; the first ``max_pairs`` by query id, or all for 0."""
    pairs = candidates.filter("skip_reason is null").select("query_id", "anchor", "positive")
    return pairs.orderBy("query_id").limit(max_pairs) if max_pairs else pairs


def write_training_pairs(candidates: DataFrame, path: str) -> dict[str, int]:
    """Write the usable pairs; gives the number of pairs and of queries left out for each reason, counted on the way."""
    counts = {"pair": F.col("skip_reason").isNull(), **{reason: F.col("skip_reason") == reason for reason in SKIP_REASONS}}
    counts = {name: F.coalesce(condition, F.lit(False)) for name, condition in counts.items()}
    return write_counted(candidates, path, counts, keep=F.col("skip_reason").isNull())


def training_report(candidates: DataFrame) -> DataFrame:
    """Number of queries per outcome."""
    return candidates.groupBy(F.coalesce("skip_reason", F.lit("pair")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("queries")
    )
