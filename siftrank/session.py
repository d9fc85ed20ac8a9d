"""Session used by the tests, the bench and the examples.

On a cluster the caller brings its own session; nothing in the library needs
settings beyond Spark's defaults (adaptive execution is on by default).
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, name: str = "siftrank") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
