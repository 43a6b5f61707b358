"""Tables and files that outlive a job, and how wide work is spread."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import cut, drop, new_path, shared_dir  # noqa: F401


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver next collects its garbage.

    Spark's cleaner works behind the collector, so it gets a moment, twice: what the first pass frees may hold more.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.7)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is set for the size of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """df on all cores: dealt anew where its scan has fewer partitions than the cluster has cores, as one small file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
