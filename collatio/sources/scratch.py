"""Tables and files that outlive a job: kept in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The URI of `spark.checkpoint.dir`. Where that is unset and driver and executors are one process (tests), a folder of our own until the process ends."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        app = spark.sparkContext.applicationId
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="collatio-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        path = f"file://{_own[app]}"
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """`df` written to the shared folder and read again: later stages don't recompute it, and lost executors don't lose it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by `cut` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rpartition("/")[0]) if df.inputFiles() else None
    if path is not None:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs or an object store), and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put(uri: str, content: bytes) -> None:
    """A file that is there whole or not at all: written under another name first."""
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as f:
        f.write(content)
    fs.move(part, path)
