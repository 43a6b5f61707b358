"""Run logs as streams: the state that last-success needs, resumption, and energy by time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import last_success


def upsert_last_success(stream: DataFrame, state: str, checkpoint: str, keys: list[str], seq: str, error: Column) -> None:
    """Keep (keys, .., last success) of an append-only log in a Parquet folder, batch by batch.

    Every batch is reduced first, merged with the rows that stand, and written as a new version beside them; a version is
    named by its batch, so a batch that runs again writes the same one. A later error never replaces a success, and the first error
    stays until a success comes. Reads `stream` until it has no more, then stops.
    """
    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = last_success(batch, keys, seq, error)
        if n:
            rows = last_success(rows.unionByName(spark.read.parquet(f"{state}/v{n - 1}")), keys, seq, error)
        rows.write.mode("overwrite").parquet(f"{state}/v{n}")
        if n > 1:  # the version before the last may be read by a batch that runs again; older ones are done with
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/v{n - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    run = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def current(spark: SparkSession, state: str) -> DataFrame:
    """The newest version of the state."""
    where = spark._jvm.org.apache.hadoop.fs.Path(state)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    newest = max((int(f.getPath().getName()[1:]) for f in found), default=None)
    if newest is None:
        raise FileNotFoundError(state)
    return spark.read.parquet(f"{state}/v{newest}")


def windows(stream: DataFrame, ts: str, value: str, keys: list[str], every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Mean and number of values by key and tumbling window; records more than `late` behind are left out."""
    out = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, every).alias("w")).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("window_start"), "mean_value", "n")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an append-mode stream to the end of its input into a Parquet folder."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def energy_wh(mean_watts: Column, seconds: Column) -> Column:
    return mean_watts * seconds / 3600
