"""Record files: strict JSON lines in, JSON lines, CSV and Parquet out, checksums."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as C
from .scratch import put


def read_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """One JSON record a line; blank lines are skipped, a missing path gives no rows.

    strict: a line that isn't JSON, or has a field the schema lacks, stops the read. The schema alone decides the types, so nothing is
    inferred from the data, and the check is part of the scan's projection.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.json_object_keys("value").alias("k"))
    if strict:
        known = F.array(*(F.lit(f.name) for f in schema))
        extra = F.array_except("k", known)
        bad = F.col("k").isNull() | (F.size(extra) > 0)
        parsed = parsed.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("not a record of this kind: "), F.substring("value", 1, 200))).cast(schema)).otherwise(F.col("r")))
    return parsed.select("r.*")


def read_runs(spark: SparkSession, folder: str, predictions: T.StructType, metas: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Predictions with run_id and seq, of runs that have a meta record; and the metas. A run is a folder with predictions.jsonl and meta.json."""
    meta = spark.read.schema(metas).option("multiLine", True).json(f"{folder}/*/meta.json")
    rows = spark.read.schema(predictions).json(f"{folder}/*/predictions.jsonl")
    run = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/predictions[.]jsonl", 1)  # a file, or a folder of parts
    placed = rows.select("*", run.alias("run_id"), F.monotonically_increasing_id().alias("seq"))
    return placed.join(meta.select("run_id").distinct(), "run_id", "left_semi"), meta


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The pages that count."""
    return read_lines(spark, path, C.PAGE)


def read_judged(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    """Stored verdicts of known pages; of several of a line and pass the one stored last counts."""
    rows = spark.read.schema(C.JUDGED).json(f"{folder}/*.jsonl").withColumn("seq", F.monotonically_increasing_id())
    keys = ["system_id", "page_id", "line_idx", "pass_idx"]
    rest = [f.name for f in C.JUDGED if f.name not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*keys, "r.*")
    return last.join(known.select("page_id").distinct(), "page_id", "left_semi")


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(prompt_id, prompt, sha256) of the text files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    name = F.regexp_extract("path", "([^/]+)[.]txt$", 1)
    return files.select(name.alias("prompt_id"), F.decode("content", "UTF-8").alias("prompt"), F.sha2("content", 256).alias("sha256"))


def write_document(path: str, document: object) -> None:
    """One small JSON document, indented, letters as they are."""
    put(path, (json.dumps(document, ensure_ascii=False, indent=2) + "\n").encode())


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write files (name, content) under a folder, by the executors; returns (name, length) once all are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                put(f"{folder}/{name}", content)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64())], ["name", "length"])

    rows = files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, length bigint").collect()
    return files.sparkSession.createDataFrame(rows, "name string, length bigint")


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """A result table as one CSV file with a header; tables are a row for each system or corpus."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def checksums(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sha256, length) of files; the contents never leave the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def verify(listed: DataFrame, present: DataFrame) -> DataFrame:
    """Files of a list (path, sha256) that are missing or altered."""
    found = present.select("path", F.col("sha256").alias("found"))
    return listed.join(found, "path", "left").where("found is null or found <> sha256").select("path", F.when(F.col("found").isNull(), "missing").otherwise("altered").alias("problem"))
