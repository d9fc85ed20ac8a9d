"""Reproducible samples: rows in the order of a salted hash of their id.

The order depends on the id alone, so a sample is the same on any number of
partitions and after any retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.operators.curation import Dataset
from siftrank.operators.merging import Artifacts, judged_ids, keep_first, keep_first_group, subset
from siftrank.operators.ranking import top_n
from siftrank.scratch import materialize


DIGITS = 4  # hexadecimal digits of the hash that one count decides


def mixed(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_column).cast("string")))


def shuffled(id_column: str, seed: int) -> list[Column]:
    """Sort order that mixes ids: the hash, then the id itself."""
    return [mixed(id_column, seed).asc(), F.col(id_column).asc()]


def hash_cut(ids: DataFrame, n: int, id_column: str, seed: int) -> Column:
    """Condition on the id that the first ``n`` rows in mixed order meet, and no others.

    The cut is found digit by digit: rows are counted by the next digits of
    their hash, the count that the n-th row falls into is opened again, and so
    on until a count ends there.  Nothing is sorted, and a round brings at most
    16 ** ``DIGITS`` counts to the driver, however many rows there are.  ``ids``
    is read once per round, so it should be a written table; a repeated id stays
    whole on one side.
    """
    value, prefix, left = mixed(id_column, seed), "", n
    if n <= 0:
        return F.lit(False)
    while True:
        width = len(prefix) + DIGITS
        inside = ids.filter(F.substring(value, 1, len(prefix)) == prefix) if prefix else ids
        counts = inside.groupBy(F.substring(value, len(prefix) + 1, DIGITS).alias("digits")).count().collect()
        for row in sorted(counts, key=lambda r: r.digits):
            if row["count"] > left:
                break
            left -= row["count"]
        else:
            return F.lit(True)  # there are not more than n
        limit = prefix + row.digits
        if left == 0:
            below = int(limit, 16) - 1
            return F.substring(value, 1, width) <= f"{below:0{width}x}" if below >= 0 else F.lit(False)
        if width == 32:
            return value <= limit
        prefix = limit


def first_mixed(ids: DataFrame, n: int, id_column: str = "query_id", seed: int = 42) -> DataFrame:
    """The first ``n`` rows in mixed order, selected by a cut of the hash."""
    return ids.filter(hash_cut(ids, n, id_column, seed))


def first_queries(queries: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` queries by id; all for None."""
    return queries if n is None else queries.orderBy("query_id").limit(n)


def split_queries(rows: DataFrame, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Every row with a ``split``; all rows of one query are on the same side.

    The first ``int(n * (1 - test_share))`` query ids in mixed order are train.
    """
    ids = materialize(rows.select("query_id").distinct(), "split_ids")
    train = hash_cut(ids, math.floor(ids.count() * (1 - test_share)), "query_id", seed)
    return rows.filter("query_id is not null").withColumn("split", F.when(train, "train").otherwise("test"))


def checked_disjoint(train: DataFrame, test: DataFrame, key: str = "query_id") -> None:
    """An error when an id is on both sides of a split."""
    if not train.select(key).intersect(test.select(key)).isEmpty():
        raise ValueError(f"some {key} is in both train and test")


def sample_queries(queries: DataFrame, n: int, seed: int) -> DataFrame:
    """The first ``n`` queries in mixed order."""
    return first_mixed(queries, n, "query_id", seed)


def stratified_sample(queries: DataFrame, size: int, seed: int = 42, by: str = "source") -> DataFrame:
    """``size`` rows shared among the groups by their part of the table, at least one each.

    Without the grouping column it is a plain sample of ``size`` rows.
    """
    if by not in queries.columns:
        return sample_queries(queries, size, seed)
    groups = queries.groupBy(by).agg(F.count(F.lit(1)).alias("_rows"))
    total = queries.agg(F.count(F.lit(1))).scalar()
    quota = groups.select(
        by, F.greatest(F.lit(1), F.bround(F.lit(size) * F.col("_rows") / total)).alias("_quota")
    )
    ranked = top_n(queries, [by], shuffled("query_id", seed), size, rank="_place")
    return ranked.join(quota, by).filter("_place <= _quota").drop("_place", "_quota")


def dev_sample(datasets: list[Dataset], train: int = 1000, test: int = 250, distractors: int = 250,
               seed: int = 42) -> Artifacts:
    """A small copy: queries per dataset, their judged products, and other products as noise.

    A distractor is any product without a kept judgement in the sample.
    """
    samples = [_sample_one(d, train, test, distractors, seed) for d in datasets]
    return Artifacts(
        products=keep_first([s.products for s in samples], ["product_id"]),
        train_qrels=keep_first_group([s.train_qrels for s in samples], "query_id"),
        test_qrels=keep_first_group([s.test_qrels for s in samples], "query_id"),
        train_queries=keep_first([s.train_queries for s in samples], ["query_id"]),
        test_queries=keep_first([s.test_queries for s in samples], ["query_id"]),
    )


def _sample_one(dataset: Dataset, train: int, test: int, distractors: int, seed: int) -> Artifacts:
    def pick(split: str, n: int) -> tuple[DataFrame, DataFrame]:
        qrels = materialize(dataset.qrels(split), "qrels")
        ids = materialize(qrels.select("query_id").distinct(), "query_ids")
        ids = sample_queries(ids, n, seed)
        return subset(qrels, ids), subset(dataset.queries(split), ids)

    train_qrels, train_queries = pick("train", train)
    test_qrels, test_queries = pick("test", test)
    # A dataset that can name its products without their texts only makes the sampled ones.
    names = dataset.product_ids() if hasattr(dataset, "product_ids") else dataset.products().select("product_id")
    judged = materialize(judged_ids(train_qrels.unionByName(test_qrels)), "judged")
    pool = materialize(distractor_pool(names, judged), "distractors")
    wanted = materialize(judged.unionByName(first_mixed(pool, distractors, "product_id", seed)), "sampled")
    kept = dataset.products(wanted) if hasattr(dataset, "product_ids") else subset(dataset.products(), wanted, "product_id")
    return Artifacts(kept, train_qrels, test_qrels, train_queries, test_queries)


def distractor_pool(products: DataFrame, judged: DataFrame) -> DataFrame:
    """Products that are not judged."""
    return products.join(judged.select("product_id"), "product_id", "left_anti")
