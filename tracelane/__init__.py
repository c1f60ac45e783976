"""Policy queries over agent traces, compiled to Spark plans."""

from __future__ import annotations

import os


def reachable(spark) -> None:
    """Lets Python workers import this package from where the driver has it, for sessions that weren't started in its folder. On a cluster
    the package is shipped or installed, and the extra path does no harm."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, home])


def bounded_batches(spark, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of bounded rows and bytes: memory of a Python worker doesn't grow with the partition. Workers can import the package."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
