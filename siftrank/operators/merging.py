"""Union of datasets, keep-first, and replacement of judgements."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.operators.curation import Dataset
from siftrank.operators.ranking import first_of
from siftrank.scratch import materialize


@dataclass(frozen=True)
class Artifacts:
    """The merged tables, all lazy."""

    products: DataFrame
    train_qrels: DataFrame
    test_qrels: DataFrame
    train_queries: DataFrame
    test_queries: DataFrame


def _stack(tables: list[DataFrame]) -> DataFrame:
    numbered = [t.withColumn("_ordinal", F.lit(i)) for i, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, numbered)


def keep_first(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all tables; for a repeated key the earliest table's row."""
    return first_of(_stack(tables), keys, [F.asc("_ordinal")]).drop("_ordinal")


def keep_first_group(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of all tables; for a key in several tables all rows of the earliest one.

    The tables are written once, as both the owner of a key and its rows are read from them.
    """
    stacked = materialize(_stack(tables), "stacked")
    owner = stacked.groupBy(key).agg(F.min("_ordinal").alias("_ordinal"))
    return stacked.join(owner, [key, "_ordinal"], "left_semi").drop("_ordinal")


def conflicts(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys found in more than one table, with the number of rows not kept."""
    return (
        _stack(tables).groupBy(key)
        .agg(F.count_distinct("_ordinal").alias("tables"), (F.count(F.lit(1)) - 1).alias("dropped"))
        .filter("tables > 1")
    )


def merge(datasets: list[Dataset]) -> Artifacts:
    """All datasets as one; the order decides which duplicate stays."""
    if not datasets:
        raise ValueError("at least one dataset is needed")
    return Artifacts(
        products=keep_first([d.products() for d in datasets], ["product_id"]),
        train_qrels=keep_first_group([d.qrels("train") for d in datasets], "query_id"),
        test_qrels=keep_first_group([d.qrels("test") for d in datasets], "query_id"),
        train_queries=keep_first([d.queries("train") for d in datasets], ["query_id"]),
        test_queries=keep_first([d.queries("test") for d in datasets], ["query_id"]),
    )


def summary(merged: Artifacts) -> DataFrame:
    """Products per source, and queries and judgements per split."""
    products = merged.products.groupBy("source").agg(F.count(F.lit(1)).alias("value")).select(
        F.concat(F.lit("products "), "source").alias("item"), "value"
    )
    parts = [products]
    for split, qrels in (("train", merged.train_qrels), ("test", merged.test_qrels)):
        parts.append(qrels.agg(
            F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("judgements")
        ).select(F.explode(F.create_map(
            F.lit(f"{split} queries"), "queries", F.lit(f"{split} judgements"), "judgements"
        )).alias("item", "value")))
    return reduce(DataFrame.unionByName, parts)


def replace_queries(base: DataFrame, update: DataFrame) -> DataFrame:
    """Judgements of ``update`` replace those of the same query in ``base``."""
    ids = update.select("query_id").distinct()
    return base.join(ids, "query_id", "left_anti").unionByName(update)


def subset(rows: DataFrame, ids: DataFrame, key: str = "query_id") -> DataFrame:
    """Rows whose key is among ``ids``."""
    return rows.join(ids.select(key), key, "left_semi")


def judged_ids(qrels: DataFrame) -> DataFrame:
    return qrels.select("product_id").distinct()


def corpus_ids(products: DataFrame, qrels: DataFrame, scope: str = "judged") -> DataFrame:
    """Ids to index: the judged ones that exist, or all products."""
    if scope == "all":
        return products.select("product_id")
    if scope != "judged":
        raise ValueError("scope must be 'judged' or 'all'")
    return judged_ids(qrels).join(products.select("product_id"), "product_id", "left_semi")


def missing_ids(products: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judged ids without a product."""
    return judged_ids(qrels).join(products.select("product_id"), "product_id", "left_anti")
