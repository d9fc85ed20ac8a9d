"""Explicit schemas of the tables that cross the library's boundary."""

from __future__ import annotations

from pyspark.sql import types as T

PRODUCT = T.StructType([
    T.StructField("product_id", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("full_text", T.StringType(), False),
    T.StructField("encode_text", T.StringType(), False),
    T.StructField("brand", T.StringType()),
    T.StructField("color", T.ArrayType(T.StringType(), False), False),
    T.StructField("product_class", T.StringType()),
    T.StructField("category_path", T.StringType()),
    T.StructField("average_rating", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("parsed_features", T.MapType(T.StringType(), T.StringType())),
])

QRELS = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("product_id", T.StringType(), False),
    T.StructField("gain", T.DoubleType(), False),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("query", T.StringType()),
])

RUN = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("product_id", T.StringType(), False),
    T.StructField("rank", T.LongType(), False),
])

WANDS_PRODUCT_TSV = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("product_class", T.StringType()),
    T.StructField("category hierarchy", T.StringType()),
    T.StructField("product_description", T.StringType()),
    T.StructField("product_features", T.StringType()),
    T.StructField("rating_count", T.StringType()),
    T.StructField("average_rating", T.StringType()),
    T.StructField("review_count", T.StringType()),
])

WANDS_QUERY_TSV = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("query_class", T.StringType()),
])

WANDS_LABEL_TSV = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("query_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("label", T.StringType()),
])
