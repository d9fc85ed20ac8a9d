"""Raw labelled datasets to products, judgements and queries."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank import fixed_values as fixed
from siftrank.functions import attributes as attr
from siftrank.functions.text import clean
from siftrank.operators.ranking import first_of, top_n


class Dataset(Protocol):
    """What a dataset offers to the merge; a new dataset needs these and nothing else."""

    source: str

    def products(self) -> DataFrame: ...

    def qrels(self, split: str) -> DataFrame: ...

    def queries(self, split: str) -> DataFrame: ...


def esci_join(examples: DataFrame, products: DataFrame) -> DataFrame:
    """Judged examples of the small US version with their product's texts.

    A product listed in several locales is matched in the example's own locale.
    """
    wanted = examples.filter((F.col("small_version") == 1) & (F.col("product_locale") == "us"))
    return wanted.drop("small_version", "large_version").join(
        products, ["product_id", "product_locale"], "left"
    ).drop("product_locale")


def wands_join(queries: DataFrame, labels: DataFrame, products: DataFrame) -> DataFrame:
    """Queries with their judged products."""
    return queries.join(labels.drop("id"), "query_id").join(products, "product_id")


def build_qrels(judged: DataFrame, *, label: str, gains: dict[str, float], prefix: str,
                keep_irrelevant: bool = False, cap: int | None = fixed.JUDGED_PER_QUERY) -> DataFrame:
    """Graded judgements: best gain per pair, at most ``cap`` products per query.

    Unknown labels and null ids are dropped; gain 0 only on request kept.
    """
    graded = judged.select(
        F.concat(F.lit(prefix), F.col("query_id").cast("string")).alias("query_id"),
        F.concat(F.lit(prefix), F.col("product_id").cast("string")).alias("product_id"),
        attr.gain(F.col(label), gains).alias("gain"),
    ).filter("gain is not null and query_id is not null and product_id is not null")
    if not keep_irrelevant:
        graded = graded.filter("gain > 0")
    best = graded.groupBy("query_id", "product_id").agg(F.max("gain").alias("gain"))
    if cap is None:
        return best
    return top_n(best, ["query_id"], [F.desc("gain"), F.asc("product_id")], cap).drop("rank")


def build_queries(judged: DataFrame, *, prefix: str, order: list[Column]) -> DataFrame:
    """One text per query id: the first in the given order."""
    first = first_of(judged.filter("query_id is not null"), ["query_id"], order)
    return first.select(F.concat(F.lit(prefix), F.col("query_id").cast("string")).alias("query_id"), "query")


def one_per_product(rows: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """One row per product: the first by the column ``order``; without one, whatever the file order, the
    smallest by the given columns, where a value comes before none.

    Copies of a product are reduced before the shuffle, and a caller that
    needs the ids only gets a plain distinct.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    filled = F.struct(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in columns])
    place = filled if order is None else F.struct(F.col(order).isNull(), F.col(order), filled)
    one = rows.filter("product_id is not null").groupBy("product_id").agg(F.min_by(row, place).alias("_row"))
    return one.select("product_id", "_row.*")


def esci_products(rows: DataFrame, order: str | None = None) -> DataFrame:
    """Unified product rows of the first dataset, one per product (see :func:`one_per_product`)."""
    texts = [clean(F.col(c)).alias(c) for c in fixed.ESCI_METADATA]
    one = one_per_product(rows, fixed.ESCI_METADATA, order).select("product_id", *texts)
    with_colors = one.withColumn("color", attr.colors(F.col("product_color")))
    title, brand = F.col("product_title"), F.col("product_brand")
    return with_colors.select(
        F.concat(F.lit(fixed.ESCI_PREFIX), F.col("product_id").cast("string")).alias("product_id"),
        F.lit("ESCI").alias("source"),
        attr.text_of(title, brand, attr.bullets(F.col("product_bullet_point")),
                     F.col("product_description")).alias("full_text"),
        attr.text_of(title, brand, F.array_join("color", " ")).alias("encode_text"),
        attr.brand(brand).alias("brand"),
        "color",
        F.lit(None).cast("string").alias("product_class"),
        F.lit(None).cast("string").alias("category_path"),
        F.lit(None).cast("double").alias("average_rating"),
        F.lit(None).cast("long").alias("review_count"),
        metadata(fixed.ESCI_METADATA).alias("metadata"),
        F.create_map().cast("map<string,string>").alias("parsed_features"),
    )


def wands_products(rows: DataFrame, order: str | None = None) -> DataFrame:
    """Unified product rows of the second dataset, one per product (see :func:`one_per_product`)."""
    one = one_per_product(rows, fixed.WANDS_METADATA, order)
    parsed = one.withColumn("parsed_features", attr.features(F.col("product_features")))
    kept = F.col("parsed_features")
    raw_color = F.coalesce(F.try_element_at(kept, F.lit("color")), F.try_element_at(kept, F.lit("colour")))
    with_colors = parsed.withColumn("color", attr.colors(raw_color))
    name, product_class = F.col("product_name"), F.col("product_class")
    category = F.col("`category hierarchy`")
    return with_colors.select(
        F.concat(F.lit(fixed.WANDS_PREFIX), F.col("product_id").cast("string")).alias("product_id"),
        F.lit("WANDS").alias("source"),
        attr.text_of(name, product_class, category, F.array_join(F.map_values(kept), " "),
                     F.col("product_description")).alias("full_text"),
        attr.text_of(name, product_class, F.array_join("color", " ")).alias("encode_text"),
        F.lit(None).cast("string").alias("brand"),
        "color",
        clean(product_class).alias("product_class"),
        clean(category).alias("category_path"),
        attr.rating(F.col("average_rating")).alias("average_rating"),
        attr.count(F.col("review_count")).alias("review_count"),
        metadata(fixed.WANDS_METADATA).alias("metadata"),
        "parsed_features",
    )


def metadata(names: list[str]) -> Column:
    """The raw columns as a map; nan counts as missing."""
    entries = []
    for name in names:
        value = F.col(f"`{name}`").cast("string")
        entries += [F.lit(name), F.when(F.lower(value) != "nan", value)]
    return F.create_map(*entries)


def _prefixed(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("product_id").cast("string")).alias("product_id")


def _unprefixed(ids: DataFrame, prefix: str) -> DataFrame:
    """The raw ids of a dataset's products."""
    own = ids.filter(F.col("product_id").startswith(prefix))
    return own.select(F.substring("product_id", len(prefix) + 1, 2 ** 31 - 1).alias("product_id"))


@dataclass(frozen=True)
class EsciDataset:
    """Examples with a ``split``, and the product table.

    Judgements and queries come from the narrow examples alone; product texts
    are read once per product, not once per example.
    """

    examples: DataFrame
    product_table: DataFrame
    order: tuple[str, ...]
    cap: int | None = fixed.JUDGED_PER_QUERY
    keep_irrelevant: bool = False
    source: str = "ESCI"

    def rows(self, split: str | None = None) -> DataFrame:
        wanted = self.examples.filter((F.col("small_version") == 1) & (F.col("product_locale") == "us"))
        return wanted if split is None else wanted.filter(F.col("split") == split)

    def product_ids(self) -> DataFrame:
        """Ids of all products, without their texts."""
        return self.rows().filter("product_id is not null").select(_prefixed(fixed.ESCI_PREFIX)).distinct()

    def products(self, ids: DataFrame | None = None) -> DataFrame:
        """All products, or those of ``ids``: raw rows are reduced to them before any text is made."""
        known = self.rows().select("product_id").distinct()
        texts = self.product_table.filter("product_locale = 'us'")
        if ids is not None:
            raw = _unprefixed(ids, fixed.ESCI_PREFIX)
            known, texts = known.join(raw, "product_id", "left_semi"), texts.join(raw, "product_id", "left_semi")
        return esci_products(known.join(texts, "product_id", "left"))

    def qrels(self, split: str) -> DataFrame:
        return build_qrels(self.rows(split), label="esci_label", gains=fixed.ESCI_GAINS,
                           prefix=fixed.ESCI_PREFIX, cap=self.cap, keep_irrelevant=self.keep_irrelevant)

    def queries(self, split: str) -> DataFrame:
        return build_queries(self.rows(split), prefix=fixed.ESCI_PREFIX, order=[F.asc(c) for c in self.order])


@dataclass(frozen=True)
class WandsDataset:
    """Queries, labels with a ``split``, and products; a label counts when both its ends exist."""

    query_table: DataFrame
    labels: DataFrame
    product_table: DataFrame
    cap: int | None = fixed.JUDGED_PER_QUERY
    keep_irrelevant: bool = False
    source: str = "WANDS"

    def rows(self, split: str | None = None) -> DataFrame:
        known = self.labels.join(self.query_table.select("query_id"), "query_id", "left_semi").join(
            self.product_table.select("product_id"), "product_id", "left_semi"
        )
        return known if split is None else known.filter(F.col("split") == split)

    def product_ids(self) -> DataFrame:
        """Ids of all products, without their texts."""
        known = self.product_table.filter("product_id is not null").select("product_id")
        return known.join(self.rows().select("product_id"), "product_id", "left_semi").select(
            _prefixed(fixed.WANDS_PREFIX)).distinct()

    def products(self, ids: DataFrame | None = None) -> DataFrame:
        """All judged products, or those of ``ids``: raw rows are reduced to them before any text is made."""
        rows = self.product_table
        if ids is not None:
            rows = rows.join(_unprefixed(ids, fixed.WANDS_PREFIX), "product_id", "left_semi")
        return wands_products(rows.join(self.rows().select("product_id"), "product_id", "left_semi"))

    def qrels(self, split: str) -> DataFrame:
        return build_qrels(self.rows(split), label="label", gains=fixed.WANDS_GAINS,
                           prefix=fixed.WANDS_PREFIX, cap=self.cap, keep_irrelevant=self.keep_irrelevant)

    def queries(self, split: str) -> DataFrame:
        judged = self.query_table.join(self.rows(split).select("query_id"), "query_id", "left_semi")
        return build_queries(judged, prefix=fixed.WANDS_PREFIX, order=[F.asc("query")])


def index_documents(products: DataFrame) -> DataFrame:
    """One searchable row per product; an empty text counts as missing."""
    raw = F.col("metadata")

    def text(name: str) -> Column:
        value = F.try_element_at(raw, F.lit(name))
        return F.when(value != "", value)

    return products.select(
        "product_id",
        "source",
        F.coalesce(text("product_title"), text("product_name")).alias("title"),
        F.try_element_at(raw, F.lit("product_brand")).alias("brand_text"),
        attr.bullets(text("product_bullet_point")).alias("bullets"),
        F.try_element_at(raw, F.lit("product_description")).alias("description"),
        "full_text", "encode_text", "brand", "color", "product_class", "average_rating", "review_count",
    )


def product_profile(products: DataFrame) -> DataFrame:
    """Counts per source: products, filled attributes, distinct brands and classes."""
    return products.groupBy("source").agg(
        F.count(F.lit(1)).alias("products"),
        F.count("brand").alias("with_brand"),
        F.count_if(F.size("color") > 0).alias("with_color"),
        F.count("product_class").alias("with_class"),
        F.count("average_rating").alias("with_rating"),
        F.count_distinct("brand").alias("brands"),
        F.count_distinct("product_class").alias("classes"),
    )
