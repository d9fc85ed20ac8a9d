"""The retrieval strategies, each for a whole table of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank import fixed_values as fixed
from siftrank.functions import models as stand_in
from siftrank.functions.text import strip, wants_title
from siftrank.functions.vectors import blend
from siftrank.operators import dense, fusion, lexical, rerank
from siftrank.operators.merging import subset
from siftrank.scratch import materialize

RowModel = Callable[[DataFrame], DataFrame]


def _title(queries: DataFrame) -> DataFrame:
    return queries.withColumn("answer", stand_in.plain_title(F.col("query")))


def _rank(listed: DataFrame) -> DataFrame:
    return listed.withColumn("answer", stand_in.overlap_answer(F.col("query"), F.col("hits")))


@dataclass(frozen=True)
class Models:
    """What the strategies call; the defaults are deterministic stand-ins.

    ``title`` and ``rank`` add an ``answer`` column to their rows, which hold
    the ``query`` or the ``prompt`` (see ``models.ask``).
    """

    encode: Callable[[Column], Column] = stand_in.bag_of_words
    score: Callable[[Column, Column], Column] = stand_in.word_overlap
    title: RowModel = _title
    rank: RowModel = _rank


def distinct_texts(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One query per distinct text and filter, and the map from every query id to it.

    Retrieval then runs once per text, however many queries share it.  The
    queries are written once, as both the texts and every use of the map read them.
    """
    wanted = F.col("filter_source") if "filter_source" in queries.columns else F.lit(None).cast("string")
    keyed = materialize(queries.select(
        "query_id", "query", wanted.alias("filter_source"), F.coalesce(wanted, F.lit("")).alias("_f")), "queries")
    one = materialize(keyed.groupBy("query", "_f").agg(
        F.min("query_id").alias("_as"), F.first("filter_source").alias("filter_source")
    ), "texts")
    ids = keyed.select("query_id", "query", "_f").join(one.select("query", "_f", "_as"), ["query", "_f"])
    return one.select(F.col("_as").alias("query_id"), "query", "filter_source"), ids.select("query_id", "_as")


def for_all(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """Hits of the distinct texts as hits of every query id."""
    return ids.join(hits.withColumnRenamed("query_id", "_as"), "_as").drop("_as")


def with_payload(hits: DataFrame, products: DataFrame, full_text: bool = True) -> DataFrame:
    """Hits with what a caller shows of each product; hits without a product stay.

    Joined after the top is known, so texts never travel through retrieval, and
    only the products that were hit are moved.
    """
    shown = ["product_id", "encode_text", "product_class", "brand", *(["full_text"] if full_text else [])]
    wanted = subset(products.select(*[c for c in shown if c in products.columns]), hits, "product_id")
    return hits.join(wanted, "product_id", "left")


@dataclass(frozen=True)
class Search:
    """Index tables and models.

    ``vectors``: product_id, source, embedding.  ``texts``: product_id, text,
    the text that rerankers read.
    """

    index: lexical.LexicalIndex
    vectors: DataFrame
    texts: DataFrame
    boosts: dict[str, float]
    models: Models = Models()
    filter_source: str | None = None
    payload: DataFrame | None = None  # product_id with full_text and product_class, for summaries
    legacy_cleaning: bool = False     # see ``clean_query``

    def shown(self) -> DataFrame:
        """What a summary shows of each product."""
        return self.texts if self.payload is None else self.payload

    def with_models(self, **models: object) -> Search:
        return replace(self, models=replace(self.models, **models))

    def encoded(self, queries: DataFrame) -> DataFrame:
        """Query vectors, written once and shared by all strategies."""
        kept = [c for c in ("query_id", "query", "filter_source") if c in queries.columns]
        return materialize(
            queries.select(*kept, self.models.encode(F.col("query")).alias("embedding")), "query-vectors"
        )

    def titled(self, encoded: DataFrame) -> DataFrame:
        """Query vectors averaged with the vector of a generated title where one is wanted."""
        wanted = encoded.withColumn("_wanted", wants_title(F.col("query")))
        answered = self.models.title(wanted.filter("_wanted"))
        first_line = F.split(strip(F.col("answer")), r"\r\n|\r|\n")[0]
        with_title = answered.withColumn("_title", F.coalesce(first_line, F.lit("")))
        mixed = with_title.withColumn("_vector", self.models.encode(F.col("_title"))).withColumn(
            "embedding",
            F.when(F.col("_title") != "", blend(F.col("embedding"), F.col("_vector"))).otherwise(F.col("embedding")),
        )
        plain = wanted.filter("not _wanted")
        return materialize(
            mixed.select(*encoded.columns).unionByName(plain.select(*encoded.columns)), "title-vectors"
        )

    def bm25(self, queries: DataFrame, k: int) -> DataFrame:
        return lexical.bm25(self.index, queries, k, self.boosts, filter_source=self.filter_source,
                            legacy=self.legacy_cleaning)

    def knn(self, encoded: DataFrame, k: int) -> DataFrame:
        return dense.knn(self.vectors, encoded, k, filter_source=self.filter_source)

    def legs(self, queries: DataFrame, encoded: DataFrame, pool: int) -> tuple[DataFrame, DataFrame]:
        """Both retrievals down to ``pool``."""
        return self.bm25(queries, pool), self.knn(encoded, pool)

    def kept_legs(self, queries: DataFrame, encoded: DataFrame, pool: int) -> tuple[DataFrame, DataFrame]:
        """Both retrievals written once, for several strategies; smaller pools are cuts by rank."""
        first, second = self.legs(queries, encoded, pool)
        return materialize(first, "lexical"), materialize(second, "dense")

    def found(self, queries: DataFrame, legs: tuple[DataFrame, DataFrame], pool: int) -> DataFrame:
        """Candidates of both legs with query and text; ``queries`` may have a ``pool`` each."""
        if "pool" in queries.columns:
            sizes = queries.select("query_id", F.col("pool").alias("_pool"))
            legs = tuple(leg.join(sizes, "query_id").filter("rank <= _pool").drop("_pool") for leg in legs)
        union = fusion.candidates(*[leg.filter(F.col("rank") <= pool) for leg in legs])
        return rerank.with_texts(materialize(union, "candidates"), queries, self.texts)

    def hybrid_rrf(self, queries: DataFrame, k: int, pool: int = fixed.POOL_FUSION,
                   rrf_k: int = fixed.RRF_K) -> DataFrame:
        return fusion.rrf(list(self.legs(queries, self.encoded(queries), pool)), k, rrf_k, with_source=True)

    def hybrid_rerank(self, queries: DataFrame, k: int, pool: int = fixed.POOL_RERANK) -> DataFrame:
        return self._pairwise(queries, self.encoded(queries), k, pool)

    def hyde_rerank(self, queries: DataFrame, k: int, pool: int = fixed.POOL_RERANK) -> DataFrame:
        return self._pairwise(queries, self.titled(self.encoded(queries)), k, pool)

    def hybrid_listwise(self, queries: DataFrame, k: int, pool: int = fixed.POOL_FUSION) -> DataFrame:
        return self._listwise(queries, self.encoded(queries), k, pool)

    def hyde_listwise(self, queries: DataFrame, k: int, pool: int = fixed.POOL_FUSION) -> DataFrame:
        return self._listwise(queries, self.titled(self.encoded(queries)), k, pool)

    def _pairwise(self, queries: DataFrame, encoded: DataFrame, k: int, pool: int) -> DataFrame:
        legs = self.legs(queries, encoded, pool)
        return rerank.pairwise(self.found(queries, legs, pool), self.models.score, k)

    def _listwise(self, queries: DataFrame, encoded: DataFrame, k: int, pool: int) -> DataFrame:
        legs = self.legs(queries, encoded, pool)
        listed = rerank.listwise_prompts(self.found(queries, legs, pool))
        return rerank.listwise(self.models.rank(listed), k)
