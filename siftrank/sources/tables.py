"""Reading and writing plain tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.schemas import QUERIES
from siftrank.sources import scans

CORRUPT = "_corrupt_record"


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str, multi_line: bool) -> DataFrame:
    """Text with a header, a record per line or, with ``multi_line``, records whose quoted fields hold line ends.

    Files of both kinds are split among tasks.  A quoted field that does not end
    on its line would be read as wrong rows by the first, plainer way, which
    stops there; the second finds the records by a scan (``scans``).
    """
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if multi_line:
        rows = scans.records(spark, path, scans.delimited(sep)).filter("not first")
        rows = rows.select(F.regexp_replace("value", r"\r$", "").alias("value")).filter("trim(value) <> ''")
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        parsed = rows.select(F.from_csv("value", kind, options).alias("row"))
        return parsed.select(*[F.col("row").getField(f.name).alias(f.name) for f in schema.fields])
    open_quote = rf'(^|{sep})"([^"]|"")*$'
    if spark.read.text(path).filter(F.col("value").rlike(open_quote)).head(1):
        raise ValueError(f"{path} has quoted line ends; read it with multi_line=True")
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def _write_delimited(df: DataFrame, path: str, sep: str) -> None:
    df.write.option("sep", sep).option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False,
             multi_line: bool = False) -> DataFrame:
    """Tab-separated text with a header; a line that does not fit keeps its raw text on request."""
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return _delimited(spark, path, schema, "\t", multi_line)


def write_tsv(df: DataFrame, path: str) -> None:
    _write_delimited(df, path, "\t")


def read_query_table(spark: SparkSession, path: str, schema: T.StructType = QUERIES, multi_line: bool = False) -> DataFrame:
    """Query table by file type: parquet, else comma-separated text with a header."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return _delimited(spark, path, schema, ",", multi_line)


def write_csv(df: DataFrame, path: str) -> None:
    _write_delimited(df, path, ",")


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], keep: Column | None = None) -> dict[str, int]:
    """Write the rows that meet ``keep`` as parquet, and give the number of all rows that meet each condition.

    The job that writes also counts, so what is left out is known without a second pass.
    """
    seen = Observation(f"counted-{uuid.uuid4().hex}")
    rows = df.observe(seen, *[F.count_if(condition).alias(name) for name, condition in counts.items()])
    (rows if keep is None else rows.filter(keep)).write.parquet(path)
    return dict(seen.get)
