"""JSON forms of judgements, runs and products, for exchange with other tools.

The primary form of each is a long parquet table.  The nested form
``{query: {product: gain}}`` is written as many objects, one per line, each
of bounded size, so neither a large file nor a query with very many rows
passes through one task as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.schemas import PRODUCT
from siftrank.sources import scans

ROWS_PER_LINE = 10_000


def _records(spark: SparkSession, path: str, opening: str, closing: str) -> DataFrame:
    """``query_id, body`` of every ``"key": [...]`` or ``"key": {...}`` in the files, however they are laid out.

    One object of any size is split among tasks, and values nest to any depth; a
    bracket in a string is text (``scans``).  What is not such a record stops the job.
    """
    # Lists end at the outermost bracket of their kind, objects inside the one that holds them all.
    found = scans.records(spark, path, scans.bracketed(opening, closing, 0 if opening == "[" else 1))
    parts = found.filter(~F.col("value").rlike(r"^[\s,{}]*$"))
    key = rf'^[\s,{{}}]*("(?:[^"\\]|\\.)*")\s*:\s*\{opening}(?s:(.*))$'
    checked = F.when(F.col("value").rlike(key), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("not a record of the nested form: "), F.substring("value", 1, 200))))
    rows = parts.select(checked.alias("value"))
    name = F.from_json(F.concat(F.lit("["), F.regexp_extract("value", key, 1), F.lit("]")), "array<string>")[0]
    return rows.select(name.alias("query_id"),
                       F.concat(F.lit(opening), F.regexp_extract("value", key, 2), F.lit(closing)).alias("body"))


def _parsed(body: str, kind: str | T.DataType) -> Column:
    """The value; a text that is not of the kind stops the job."""
    value = F.from_json(body, kind)
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("cannot be read: "), F.substring(body, 1, 200))))


def write_qrels_json(qrels: DataFrame, path: str, rows_per_line: int = ROWS_PER_LINE) -> None:
    """``{"query": {"product": gain}}`` lines; a large query takes several lines."""
    sizes = qrels.groupBy("query_id").agg(F.ceil(F.count(F.lit(1)) / rows_per_line).alias("_lines"))
    parts = qrels.join(sizes, "query_id").withColumn("_line", F.pmod(F.xxhash64("product_id"), "_lines"))
    lines = parts.groupBy("query_id", "_line").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("product_id", "gain")))).alias("judged")
    )
    lines.select(F.to_json(F.create_map("query_id", "judged")).alias("value")).write.text(path)


def read_qrels_json(spark: SparkSession, path: str) -> DataFrame:
    """Long judgements from ``{query: {product: gain}}``, in one object or in many; a query without judgements
    has a row with nulls."""
    return _records(spark, path, "{", "}").select(
        "query_id", F.explode_outer(_parsed("body", "map<string,double>")).alias("product_id", "gain"))


def write_run_json(run: DataFrame, path: str, rows_per_line: int = ROWS_PER_LINE) -> None:
    """Lines ``{"query_id", "offset", "products"}``; a long ranking takes several lines."""
    place = F.floor((F.col("rank") - 1) / rows_per_line) * rows_per_line
    lines = run.groupBy("query_id", place.alias("offset")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "product_id"))).alias("hits")
    )
    lines.select("query_id", "offset", F.col("hits.product_id").alias("products")).write.json(path)


def read_run_json(spark: SparkSession, path: str) -> DataFrame:
    """Long run from the lines of :func:`write_run_json`."""
    lines = spark.read.schema("query_id string, offset long, products array<string>").json(path)
    return lines.select("query_id", "offset", F.posexplode("products").alias("at", "product_id")).select(
        "query_id", "product_id", (F.col("offset") + F.col("at") + 1).alias("rank")
    )


def write_ranked_json(run: DataFrame, path: str) -> None:
    """``{query: [product, ...]}`` lines, one per query; a query's list is as deep as its ranking."""
    lists = run.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "product_id"))).alias("hits"))
    line = F.create_map(F.col("query_id").cast("string"), F.transform("hits", lambda h: h["product_id"].cast("string")))
    lists.select(F.to_json(line).alias("value")).write.text(path)


def read_ranked_json(spark: SparkSession, path: str) -> DataFrame:
    """Long run from ``{query: [product, ...]}``, in one object or in many."""
    return _records(spark, path, "[", "]").select(
        "query_id", F.posexplode(_parsed("body", "array<string>")).alias("at", "product_id")
    ).select("query_id", "product_id", (F.col("at") + 1).cast("long").alias("rank"))


def write_product_store(products: DataFrame, path: str, one_object: bool = False) -> None:
    """``{product: {...}}`` lines, one per product; with ``one_object`` each file is one object of all its products."""
    key, body = F.to_json(F.array(F.col("product_id").cast("string"))), F.to_json(F.struct(*products.columns))
    entry = F.concat(F.regexp_extract(key, r"(?s)^\[(.*)\]$", 1), F.lit(": "), body)
    if not one_object:
        products.select(F.concat(F.lit("{"), entry, F.lit("}")).alias("value")).write.text(path)
        return

    def enclose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "{"
        for batch in batches:
            lines = []
            for line in batch.column(0).to_pylist():
                lines.append(before + line)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if before == "{" else "}"], pa.string())], names=["value"])

    products.select(entry.alias("value")).mapInArrow(enclose, "value string").write.text(path)


def read_product_store(spark: SparkSession, path: str, schema: T.StructType = PRODUCT) -> DataFrame:
    """Products from the lines of :func:`write_product_store`, or from files that are one object each, of any size."""
    rows = _records(spark, path, "{", "}").select(F.col("query_id").alias("key"), _parsed("body", schema).alias("row"))
    return rows.select(
        F.coalesce(F.col("row.product_id"), F.col("key")).alias("product_id"),
        *[F.col("row").getField(f.name).alias(f.name) for f in schema.fields if f.name != "product_id"])


def write_products_json(products: DataFrame, path: str) -> None:
    """One product per line."""
    products.write.json(path)
