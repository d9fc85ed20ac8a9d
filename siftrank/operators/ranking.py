"""Top rows per group and full ranks that hold when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.scratch import PART_BYTES, materialize, read_bytes

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank",
          salts: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group with their 1-based position.

    Spark cuts each input partition to ``n`` rows per group before the shuffle
    for ``n`` up to its threshold.  Beyond it the group is cut in ``salts``
    parts first (as many as the input has tasks' worth of bytes), so one task
    sees at most ``n * salts`` rows of a group.
    """
    if n > int(df.sparkSession.conf.get(GROUP_LIMIT)):
        salts = salts or max(64, read_bytes(df) // PART_BYTES)
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn(rank, F.row_number().over(part)).filter(F.col(rank) <= n).drop("_salt", rank)
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(rank, F.row_number().over(window))
        .filter(F.col(rank) <= n)
        .withColumn(rank, F.col(rank).cast("long"))
    )


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_n(df, keys, order, 1, rank="_first").drop("_first")


def full_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Position of every row in its group, or in the whole table for no keys.

    Rows are range-partitioned by key and order, so a huge group is spread over
    many tasks.  The ranged table is written once to pin its partitions; a
    row's position is its place inside its partition plus the rows of the group
    in earlier partitions.
    """
    by = [F.col(k) for k in keys] + order
    ranged = df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    pinned = materialize(ranged, "ranged")
    group = ["_part", *keys]
    inside = pinned.withColumn(
        "_inside", F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    )
    # One row per range partition and key it holds: at most keys + partitions rows,
    # and per key at most one row per partition.
    sizes = pinned.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    return (
        inside.join(offsets, group)
        .withColumn(rank, (F.col("_inside") + F.col("_before")).cast("long"))
        .drop("_part", "_inside", "_before")
    )
