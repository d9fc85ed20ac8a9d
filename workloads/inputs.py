"""The given tables in the roles the library expects.

* Dataset one (ESCI layout): customers are queries, parts are products, orders
  are judgements with the priority as label.
* Dataset two (WANDS layout): nations are queries, suppliers are products,
  line items are judgements with the return flag as label.
* Texts: ``documents`` searched with ``benchmark``; vectors: ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftrank.fixed_values import ESCI_GAINS
from siftrank.operators.curation import (
    EsciDataset, WandsDataset, build_qrels, esci_join, esci_products, index_documents, wands_join,
)
from siftrank.operators.sampling import split_queries
from siftrank.scratch import fan_out_rows, materialize, spread

ESCI_ORDER = ("row_no", "product_id")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(column: str) -> Column:
    return F.col(column).cast("string")


def esci_examples(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    lines = fan_out_rows(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"
    ), "l_orderkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    return joined.select(
        text("o_custkey").alias("query_id"),
        F.concat(F.lit("looking for a "), "p_name").alias("query"),
        text("l_partkey").alias("product_id"),
        F.when(F.col("l_linestatus") == "F", "us").otherwise("es").alias("product_locale"),
        F.expr("""case substr(o_orderpriority, 1, 1) when '1' then ' exact ' when '2' then 'S'
                  when '3' then 'complement' when '4' then 'I' else 'unknown' end""").alias("esci_label"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("small_version"),
        F.lit(1).alias("large_version"),
        F.when(F.col("o_orderstatus") == "F", "train").otherwise("test").alias("split"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no"),
    )


def esci_product_table(spark: SparkSession, sf: str) -> DataFrame:
    parts = spread(table(spark, sf, "part"))

    def locale(name: str, prefix: str) -> DataFrame:
        return parts.select(
            text("p_partkey").alias("product_id"),
            F.lit(name).alias("product_locale"),
            F.concat(F.lit(prefix), "p_name").alias("product_title"),
            F.concat("p_type", F.lit(" part of size "), text("p_size")).alias("product_description"),
            F.concat(F.lit("Size: "), text("p_size"), F.lit("|\nType: "), "p_type").alias("product_bullet_point"),
            F.when(F.col("p_size") == 10, "nan").otherwise(F.concat(F.lit(" "), "p_brand", F.lit("\t")))
            .alias("product_brand"),
            F.concat(F.regexp_replace("p_name", " ", "/"), F.lit("-Gold, deep RED")).alias("product_color"),
        )

    return locale("us", "").unionByName(locale("es", "pieza "))


def wands_product_table(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier")
    nations = table(spark, sf, "nation")
    regions = table(spark, sf, "region")
    placed = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return placed.select(
        text("s_suppkey").alias("product_id"),
        F.col("s_name").alias("product_name"),
        F.col("n_name").alias("product_class"),
        F.concat("r_name", F.lit(" / "), "n_name").alias("category hierarchy"),
        F.concat(F.lit("Supplier in "), "n_name").alias("product_description"),
        F.concat(F.lit("Color:Red/Blue | Nation: "), "n_name", F.lit(" |note|Region :"), "r_name",
                 F.lit("| nation:last:"), "n_name").alias("product_features"),
        text("s_nationkey").alias("rating_count"),
        F.when(F.col("s_acctbal") > 9000, "nan").otherwise(
            F.format_string("%.1f", F.floor(F.col("s_acctbal") / 100) / 10)
        ).alias("average_rating"),
        F.concat(F.lit(" "), F.floor("s_acctbal").cast("string"), F.lit(".75")).alias("review_count"),
    )


def wands_query_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        text("n_nationkey").alias("query_id"),
        F.concat(F.lit("great rugs from "), F.lower("n_name")).alias("query"),
        F.lit("rugs").alias("query_class"),
    )


def wands_labels(spark: SparkSession, sf: str) -> DataFrame:
    lines = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"))
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        text("s_nationkey").alias("query_id"),
        text("l_suppkey").alias("product_id"),
        F.expr("case l_returnflag when 'A' then 'Exact' when 'N' then ' partial' else 'Irrelevant' end").alias("label"),
    )


def esci_joined(spark: SparkSession, sf: str) -> DataFrame:
    return esci_join(esci_examples(spark, sf), esci_product_table(spark, sf))


def wands_joined(spark: SparkSession, sf: str) -> DataFrame:
    labels = wands_labels(spark, sf)
    joined = wands_join(wands_query_table(spark, sf), labels.withColumn("_id", F.col("id")), wands_product_table(spark, sf))
    return joined.withColumnRenamed("_id", "id")


def esci(spark: SparkSession, sf: str) -> EsciDataset:
    examples = materialize(esci_examples(spark, sf), "examples")
    return EsciDataset(examples, esci_product_table(spark, sf), ESCI_ORDER)


def wands(spark: SparkSession, sf: str) -> WandsDataset:
    labels = materialize(split_queries(wands_labels(spark, sf)), "labels")
    return WandsDataset(wands_query_table(spark, sf), labels, wands_product_table(spark, sf))


def shop_judged(spark: SparkSession, sf: str) -> DataFrame:
    """All order lines as judged pairs, before the dataset's own filters."""
    return esci_examples(spark, sf).select("query_id", "query", "product_id", "esci_label", "row_no")


def shop_qrels(spark: SparkSession, sf: str) -> DataFrame:
    return build_qrels(shop_judged(spark, sf), label="esci_label", gains=ESCI_GAINS, prefix="")


def shop_run(qrels: DataFrame) -> DataFrame:
    """Judged products in the order of their ids, as a run to measure."""
    order = Window.partitionBy("query_id").orderBy("product_id")  # at most the judgement cap per query
    return qrels.select(
        "query_id", "product_id", F.row_number().over(order).cast("long").alias("rank")
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("product_id"), "source", "text")


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("product_id"), F.concat(F.lit("label"), text("label")).alias("source"), "embedding"
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def shop_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All parts as searchable product rows."""
    products = esci_product_table(spark, sf).filter("product_locale = 'us'")
    return index_documents(esci_products(products))


def shop_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct part name with its type, as a shopper would ask for it."""
    return table(spark, sf, "part").select(
        F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("query_id"),
        F.concat(F.lit("I'm looking for a nice "), "p_name", F.lit(" "), F.lower("p_type")).alias("query"),
    ).distinct()
